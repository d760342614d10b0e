"""Treatment effects: merging treated with untreated pools, and effects per matched pair of cells.

The treatment is a factor with levels 0 (control) and 1 (treated); a feature
profile ``rest_profile`` is a profile without the treatment bit.  Where a
treated partition t and a control partition c meet, the cells they share form
the boxes of their common refinement, whose cut mask is ``t | c``.  Overlaps
and effects are written down from that mask; pools are never paired up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.groups import attach
from poolwise.functions.running import running
from poolwise.runtime import bounded, materialize, scalar
from poolwise.spec import FactorSpec

# Deal out the growing matchings in each of the first rounds, then after this many treated pools.
ROUNDS_PER_SHUFFLE = 4


def treatment_bit(spec: FactorSpec, treatment: str) -> int:
    return 1 << (spec.m - 1 - spec.names.index(treatment))


def partition_pairs(spec: FactorSpec, members: DataFrame, treatment: str, weight: str | None = None,
                    per_model: bool = False) -> DataFrame:
    """Distinct (rest_profile, mask_t, mask_c) over the models (T6), with the summed weight if asked for.

    ``per_model`` keeps one row per model instead.

    ``members`` is the long form (model_key, profile_id, cut_mask).  A profile
    without data leaves its mask null.
    """
    bit = treatment_bit(spec, treatment)
    treated = F.col("profile_id").bitwiseAND(F.lit(bit)) != 0
    rest = F.col("profile_id").bitwiseAND(F.lit(spec.full_profile ^ bit))
    w = F.max(weight) if weight else F.lit(1)
    wide = (members.groupBy("model_key", rest.alias("rest_profile"))
            .agg(F.max(F.when(treated, F.col("cut_mask"))).alias("mask_t"),
                 F.max(F.when(~treated, F.col("cut_mask"))).alias("mask_c"), w.alias("weight")))
    if per_model:
        return wide
    out = wide.groupBy("rest_profile", "mask_t", "mask_c").agg(F.sum("weight").alias("weight"))
    return out if weight else out.drop("weight")


def refinement(spec: FactorSpec, pairs: DataFrame, treatment: str) -> DataFrame:
    """One row per box of the common refinement, with the treated and the control pool around it.

    ``n_cells`` is the number of matched cell pairs in it.
    """
    ti = spec.names.index(treatment)
    shared = "(coalesce(mask_t, 0L) | coalesce(mask_c, 0L))"
    df = spec.mask_boxes(pairs, shared, "rest_profile").withColumnRenamed("box_id", "shared_box")
    def side(level, mask):
        lows = [str(level) if i == ti else spec.box_low_sql(i, "shared_box") for i in range(spec.m)]
        return f"if({mask} is not null, {spec.containing_box_sql(lows, mask)}, null)"
    return df.selectExpr("*", f"{side(1, 'mask_t')} as box_t", f"{side(0, 'mask_c')} as box_c",
                         f"{spec.box_volume_sql('shared_box')} as n_cells")


def overlap(spec: FactorSpec, pairs: DataFrame, treatment: str) -> DataFrame:
    """(rest_profile, mask_t, mask_c, box_t, box_c) for pools that share a cell but for the treatment."""
    both = pairs.where(F.col("mask_t").isNotNull() & F.col("mask_c").isNotNull())
    return refinement(spec, both, treatment).select("rest_profile", "mask_t", "mask_c", "box_t", "box_c")


def can_merge(spec: FactorSpec, treatment: str) -> Column:
    """Both sides have a partition, and the control side is not a design of a single cell."""
    ti = spec.names.index(treatment)
    rest = [i for i in range(spec.m) if i != ti]
    active = " + ".join(f"if({spec.active_sql(i, 'rest_profile')}, 1, 0)" for i in rest)
    wide = " or ".join(spec.active_sql(i, "rest_profile") for i in rest if spec.levels[i] > 2) or "false"
    return F.expr(f"mask_t is not null and mask_c is not null and (({active}) >= 2 or {wide})")


def merge_costs(spec: FactorSpec, overlaps: DataFrame, boxes: DataFrame) -> DataFrame:
    """Growth of the squared error when an overlapping pair of pools is united.

    Uniting costs n1 n2 / (n1 + n2) (m1 - m2)^2, and costs of disjoint merges
    add up; a pool without data costs nothing.
    """
    def side(s):
        return bounded(boxes.select(F.col("box_id").alias(f"box_{s}"), F.col("n").alias(f"n_{s}"), F.col("mean_y").alias(f"m_{s}")), spec.n_boxes)
    df = overlaps.join(side("t"), "box_t", "left").join(side("c"), "box_c", "left")
    gap = F.col("m_t") - F.col("m_c")
    cost = F.col("n_t") * F.col("n_c") / (F.col("n_t") + F.col("n_c")) * gap * gap
    return df.withColumn("d_sse", F.coalesce(cost, F.lit(0.0))).drop("n_t", "n_c", "m_t", "m_c")


def merged_assignment(spec: FactorSpec, pairs: DataFrame, treatment: str, merges: DataFrame) -> DataFrame:
    """Pool of each box after the chosen merges (T2): matched pools share the id of the control pool.

    ``pairs`` and ``merges`` share rest_profile, mask_t, mask_c; merges adds
    (box_t, box_c).
    """
    keys = ["rest_profile", "mask_t", "mask_c"]
    bit = treatment_bit(spec, treatment)
    sides = pairs.select(*keys, F.explode(F.array(
        F.struct((F.col("rest_profile") + bit).alias("profile_id"), F.col("mask_t").alias("cut_mask"), F.lit("t").alias("side")),
        F.struct(F.col("rest_profile").alias("profile_id"), F.col("mask_c").alias("cut_mask"), F.lit("c").alias("side")))).alias("_s"))
    pools = spec.mask_boxes(sides.select(*keys, "_s.*"))
    mix = merges.select(*keys, F.col("box_t").alias("box_id"), F.col("box_c").alias("_mix"))
    return (pools.join(mix, keys + ["box_id"], "left")
            .withColumn("merged_box", F.coalesce("_mix", "box_id")).drop("_mix"))


def search_merges(spec: FactorSpec, base: DataFrame, costs: DataFrame, n_total: int, theta: float, reg: float,
                  max_merges: int | None = None, merge_reg: float | None = None) -> DataFrame:
    """All partial matchings of overlapping pools with q <= theta (T4, T5), for all pairs at once.

    ``base`` has (rest_profile, mask_t, mask_c, sse, h).  Treated pools are
    taken one after the other; a row either leaves the pool alone or unites it
    with a control pool it has not used.  The choices of a round stand in a table
    of their own, with the best that the pools after it can still give, and meet
    the rows by pair; costs add up, so a row is dropped as soon as its loss plus
    that best exceeds theta.  Rows carry their merges only.  They are dealt out by
    pair and merges from the first round on, so one pair with many matchings
    spreads as it grows.  ``merge_reg`` replaces the penalty of merged rows.
    """
    keys = ["rest_profile", "mask_t", "mask_c"]
    n, lam = F.lit(float(n_total)), F.lit(float(reg))
    costs = materialize(costs.select(*keys, "box_t", "box_c", "d_sse"), "costs")
    pools = costs.groupBy(*keys, "box_t").agg(F.least(F.lit(0.0), F.min(F.col("d_sse") / n - lam)).alias("_gain"))
    pools = materialize(running(pools, keys, ["box_t"], sums={"_upto": "_gain"}, position="_round"), "pools")
    pools = attach(pools, keys, _all=F.sum("_gain")).withColumn("_left", F.col("_all") - F.col("_upto"))
    none = F.struct(F.lit(None).cast("long").alias("box_c"), F.lit(0.0).alias("d_sse"))
    choices = pools.join(costs, keys + ["box_t"]).select(*keys, "_round", "_left", "box_t", "box_c", "d_sse")
    choices = materialize(choices.unionByName(pools.select(*keys, "_round", "_left", "box_t", none.alias("_o")).select(*keys, "_round", "_left", "box_t", "_o.*")), "choices")
    df = materialize(base.select(*keys, "sse", "h").withColumn("merges", F.expr("cast(array() as array<struct<box_t:bigint,box_c:bigint>>)")), "matchings")
    rounds = scalar(choices.agg(F.max("_round"))) or 0
    loss = F.col("sse") / n + lam * F.col("h")
    for r in range(1, rounds + 1):
        free = F.expr("box_c is null or not exists(merges, m -> m.box_c = box_c)")
        if max_merges is not None:
            free = free & (F.col("box_c").isNull() | (F.size("merges") < max_merges))
        merged = F.col("box_c").isNotNull()
        df = (df.join(choices.where(F.col("_round") == r).drop("_round"), keys, "left").where(free)
              .select(*keys, (F.col("sse") + F.coalesce("d_sse", F.lit(0.0))).alias("sse"), F.when(merged, F.col("h") - 1).otherwise(F.col("h")).alias("h"),
                      F.when(merged, F.concat("merges", F.array(F.struct("box_t", "box_c")))).otherwise(F.col("merges")).alias("merges"),
                      F.coalesce("_left", F.lit(0.0)).alias("_left")))
        if merge_reg is None:
            # a hair of slack: the open gains are summed in another order than the losses
            df = df.where(loss + F.col("_left") <= theta + 1e-12)
        df = df.drop("_left")
        if r < rounds and (r < ROUNDS_PER_SHUFFLE or r % ROUNDS_PER_SHUFFLE == 0):
            df = materialize(df.repartition(*keys, "merges"), "matchings")
    final = loss if merge_reg is None else \
        F.col("sse") / n + F.col("h") * F.when(F.size("merges") > 0, F.lit(float(merge_reg))).otherwise(lam)
    return df.withColumn("q", final).where(F.col("q") <= theta).select(*keys, "merges", "sse", "h", "q")


def pair_base(spec: FactorSpec, pairs: DataFrame, sets: DataFrame, treatment: str) -> DataFrame:
    """Error and size of each (treated, control) pair before merging: the sum of its sides."""
    bit = treatment_bit(spec, treatment)
    one = sets.select("profile_id", "cut_mask", "sse", "h")
    t = one.select((F.col("profile_id") - bit).alias("rest_profile"), F.col("cut_mask").alias("mask_t"), F.col("sse").alias("_st"), F.col("h").alias("_ht"))
    c = one.select(F.col("profile_id").alias("rest_profile"), F.col("cut_mask").alias("mask_c"), F.col("sse").alias("_sc"), F.col("h").alias("_hc"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return (pairs.join(t, ["rest_profile", "mask_t"], "left").join(c, ["rest_profile", "mask_c"], "left")
            .withColumn("sse", z("_st") + z("_sc")).withColumn("h", z("_ht") + z("_hc"))
            .select("rest_profile", "mask_t", "mask_c", "sse", "h"))


def treatment_sets(spec: FactorSpec, members: DataFrame, sets: DataFrame, boxes: DataFrame, treatment: str,
                   n_total: int, theta: float, reg: float, max_merges: int | None = None,
                   merge_reg: float | None = None) -> DataFrame:
    """Merge search for every distinct pair of the model set.

    Pairs that cannot merge pass with the sum of their losses.
    """
    pairs = materialize(pair_base(spec, partition_pairs(spec, members, treatment), sets, treatment), "pairs")
    open_pairs = pairs.where(can_merge(spec, treatment))
    costs = merge_costs(spec, overlap(spec, open_pairs, treatment), boxes)
    found = search_merges(spec, open_pairs, costs, n_total, theta, reg, max_merges, merge_reg)
    fixed = (pairs.where(~can_merge(spec, treatment))
             .withColumn("merges", F.expr("cast(array() as array<struct<box_t:bigint,box_c:bigint>>)"))
             .withColumn("q", F.col("sse") / F.lit(float(n_total)) + F.lit(float(reg)) * F.col("h")))
    return found.unionByName(fixed.select(*found.columns))


def entry_name() -> Column:
    """Name of a treatment set's entry inside model keys: feature profile, both masks and the merges."""
    merges = F.array_join(F.transform("merges", lambda m: F.concat_ws("~", m["box_t"].cast("string"), m["box_c"].cast("string"))), ",")
    return F.concat_ws(":", F.col("rest_profile").cast("string"), F.coalesce(F.col("mask_t").cast("string"), F.lit("")),
                       F.coalesce(F.col("mask_c").cast("string"), F.lit("")), merges)


def combine_treatment_sets(spec: FactorSpec, te_sets: DataFrame, treatment: str, theta: float) -> DataFrame:
    """One merged pair per feature profile with total loss at most theta."""
    from poolwise.operators.models import combine
    ti = spec.names.index(treatment)
    rest = [i for i in range(spec.m) if i != ti]
    # feature profiles are numbered without the treatment bit
    slot = F.expr(" + ".join(f"if({spec.active_sql(i, 'rest_profile')}, {1 << (len(rest) - 1 - k)}, 0)" for k, i in enumerate(rest)))
    items = te_sets.select(slot.cast("int").alias("slot"), "q", F.col("h").cast("long").alias("h"), F.array(entry_name()).alias("members"))
    have = te_sets.select(slot.cast("int").alias("slot")).distinct()
    blank = (te_sets.sparkSession.range(2 ** (spec.m - 1)).select(F.col("id").cast("int").alias("slot"))
             .join(have, "slot", "left_anti")
             .select("slot", F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("h"), F.expr("cast(array() as array<string>)").alias("members")))
    out = combine(items.unionByName(blank), 2 ** (spec.m - 1), theta)
    return out.select(F.array_join(F.array_sort("members"), "|").alias("model_key"), F.col("q").alias("loss"), F.col("h").alias("n_pools"))


def usable_treatment_sets(te_sets: DataFrame, theta: float) -> DataFrame:
    """Entries that occur in some combination.

    An entry does iff it fits together with the best entries of all other
    feature profiles; this is also the loss-ordered prefix up to the last used
    one.
    """
    low = te_sets.groupBy("rest_profile").agg(F.min("q").alias("_low"))
    best = low.agg(F.sum("_low")).scalar()
    return (te_sets.join(F.broadcast(low), "rest_profile").withColumn("_base", best)
            .where(F.col("_base") - F.col("_low") + F.col("q") <= theta).drop("_low", "_base"))


def matched_cells(spec: FactorSpec, policies_df: DataFrame, treatment: str, treated_level: int = 1, control_level: int = 0) -> DataFrame:
    """(control_id, treated_id) for cells equal in all other factors (T8), by id offset."""
    i = spec.names.index(treatment)
    step = (treated_level - control_level) * spec.strides[i]
    return (policies_df.where(spec.level(i) == control_level)
            .withColumn("treated_id", F.col("policy_id") + F.lit(step).cast("long"))
            .withColumnRenamed("policy_id", "control_id"))


def pair_effects(spec: FactorSpec, pairs: DataFrame, boxes: DataFrame, treatment: str) -> DataFrame:
    """Effect per (pair of partitions, shared box).

    A side without data makes the effect 0; boxes where both sides lack data
    are left out.
    """
    def side(s):
        return bounded(boxes.select(F.col("box_id").alias(f"box_{s}"), F.col("mean_y").alias(f"m_{s}")), spec.n_boxes)
    df = refinement(spec, pairs, treatment).join(side("t"), "box_t", "left").join(side("c"), "box_c", "left")
    # a pool that exists but holds no rows has mean 0; a missing partition has none
    m_t = F.when(F.col("mask_t").isNotNull(), F.coalesce("m_t", F.lit(0.0)))
    m_c = F.when(F.col("mask_c").isNotNull(), F.coalesce("m_c", F.lit(0.0)))
    return (df.where(F.col("mask_t").isNotNull() | F.col("mask_c").isNotNull())
            .withColumn("effect", F.coalesce(m_t - m_c, F.lit(0.0))).drop("m_t", "m_c"))


def merged_effects(spec: FactorSpec, te_sets: DataFrame, boxes: DataFrame, treatment: str) -> DataFrame:
    """Effect per (entry, shared box) after the entry's merges (T9 on T2).

    A merged pool has one mean for both sides: boxes inside it have effect 0, and elsewhere the mean of the union meets
    that of the pool across.  The rules for missing data are those of ``pair_effects``.
    """
    def partner(own, other):
        return F.get(F.filter("merges", lambda m: m[own] == F.col(own)), F.lit(0))[other]

    df = refinement(spec, te_sets, treatment).withColumns({"_with_t": partner("box_t", "box_c"), "_with_c": partner("box_c", "box_t")})
    for box in ("box_t", "box_c", "_with_t", "_with_c"):
        part = boxes.select(F.col("box_id").alias(box), F.col("n").alias(f"_n_{box}"), F.col("sum_y").alias(f"_y_{box}"))
        df = df.join(bounded(part, spec.n_boxes), box, "left").fillna(0, [f"_n_{box}", f"_y_{box}"])

    def mean(mask, *parts):
        rows, total = (sum((F.col(f"_{k}_{b}") for b in parts), F.lit(0)) for k in "ny")
        return F.when(F.col(mask).isNotNull(), F.coalesce(F.try_divide(total, rows), F.lit(0.0)))

    gap = F.coalesce(mean("mask_t", "box_t", "_with_t") - mean("mask_c", "box_c", "_with_c"), F.lit(0.0))
    effect = F.when(F.col("_with_t") == F.col("box_c"), 0.0).otherwise(gap)
    return (df.where(F.col("mask_t").isNotNull() | F.col("mask_c").isNotNull()).withColumn("effect", effect)
            .drop("merges", *[c for c in df.columns if c.startswith("_")]))


def model_entries(models: DataFrame) -> DataFrame:
    """Models as (entries, weight): the names in their key, and exp(best loss - loss)."""
    best = models.agg(F.min("loss")).scalar()
    return models.withColumn("_best", best).select(F.split("model_key", "[|]").alias("entries"), F.exp(F.col("_best") - F.col("loss")).alias("weight"))


def weighted_entries(te_sets: DataFrame, models: DataFrame) -> DataFrame:
    """Entries that models use, with the number of these models and their mean weight.

    Effects are then read once per entry, however many models share it.
    """
    used = (model_entries(models).select(F.explode("entries").alias("entry"), "weight")
            .groupBy("entry").agg(F.count("*").alias("n_models"), F.avg("weight").alias("weight")))
    return te_sets.withColumn("entry", entry_name()).join(used, "entry")


def weighted_contrasts(spec: FactorSpec, te_sets: DataFrame, models: DataFrame, boxes: DataFrame, treatment: str, group: str,
                       high: int = 1, low: int = 0) -> DataFrame:
    """Difference of merged effects between two levels of ``group`` per cell (T10), with number and mean weight of the models.

    Rows stand for pairs of entries that some model holds together, one for each level; ``rest_profile`` and
    ``control_id`` are those of the low level.
    """
    i = spec.names.index(group)
    bit = 1 << (spec.m - 1 - i)
    rest = lambda e: f"cast(split_part({e}, ':', 1) as int)"
    holds = lambda e, level: f"({rest(e)} & {bit}) {'!=' if level else '='} 0"
    base = lambda e: f"({rest(e)} & {spec.full_profile ^ bit})"
    beside = f"get(filter(entries, o -> {holds('o', low)} and {base('o')} = {base('e')}), 0)"
    pairs = (model_entries(models)
             .selectExpr(f"inline(transform(filter(entries, e -> {holds('e', high)}), e -> named_struct('entry_high', e, 'entry_low', {beside}, 'weight', weight)))")
             .where("entry_low is not null").groupBy("entry_high", "entry_low").agg(F.count("*").alias("n_models"), F.avg("weight").alias("weight")))
    cell = effects_by_cell(spec, merged_effects(spec, te_sets.withColumn("entry", entry_name()), boxes, treatment))
    above = (cell.where(spec.level(i, "control_id") == high)
             .select(F.col("entry").alias("entry_high"), (F.col("control_id") + (low - high) * spec.strides[i]).alias("control_id"), F.col("effect").alias("effect_high")))
    under = (cell.where(spec.level(i, "control_id") == low)
             .select(F.col("entry").alias("entry_low"), "rest_profile", "control_id", F.col("effect").alias("effect_low")))
    return (pairs.join(above, "entry_high").join(under, ["entry_low", "control_id"])
            .withColumn("contrast", F.col("effect_high") - F.col("effect_low")))


def effects_by_cell(spec: FactorSpec, effects: DataFrame) -> DataFrame:
    """Unfold shared boxes into the control cells of the matched pairs."""
    return spec.box_policies(effects, "shared_box", "control_id")


def effect_contrast(spec: FactorSpec, cell_effects: DataFrame, group: str, keys: list[str],
                    high: int = 1, low: int = 0) -> DataFrame:
    """Difference of effects between two levels of another factor, per matched cell.

    ``cell_effects`` has control_id and effect per ``keys`` (the model).
    """
    i = spec.names.index(group)
    a = cell_effects.where(spec.level(i, "control_id") == high).select(*keys, F.col("control_id"), F.col("effect").alias("effect_high"))
    b = (cell_effects.where(spec.level(i, "control_id") == low)
         .select(*keys, (F.col("control_id") + (high - low) * spec.strides[i]).alias("control_id"), F.col("effect").alias("effect_low")))
    return a.join(b, [*keys, "control_id"]).withColumn("contrast", F.col("effect_high") - F.col("effect_low"))


def effect_table(spec: FactorSpec, effects_long: DataFrame, treatment: str, outcome: str, outcomes: list[str],
                 value: str = "beta", treated_level: int = 1, control_level: int = 0) -> DataFrame:
    """Treated minus control per cell and outcome, outcomes as columns (T11), matched by key."""
    i = spec.names.index(treatment)
    wide = effects_long.groupBy("policy_id").pivot(outcome, outcomes).agg(F.first(value))
    t = wide.where(spec.level(i) == treated_level).select(
        (F.col("policy_id") - (treated_level - control_level) * spec.strides[i]).alias("policy_id"), *[F.col(o).alias(f"_t_{o}") for o in outcomes])
    c = wide.where(spec.level(i) == control_level)
    return c.join(t, "policy_id").select(F.col("policy_id").alias("control_id"), *[(F.col(f"_t_{o}") - F.col(o)).alias(o) for o in outcomes])
