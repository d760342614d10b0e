"""Models: one partition per profile (or stratum), combined under one loss threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.operators.partitions import box_moments, score_space, space_errors
from poolwise.functions.running import running
from poolwise.operators.search import TOLERANCE, frontier_set
from poolwise.runtime import bounded, discard, materialize, scalar
from poolwise.spec import FactorSpec

# Bands of excess loss with about as many rows each, for the band join of a merge round.
BANDS = 16
# Pairs of a merge that one salt may hold before the right side is copied, and most copies.
PAIRS_PER_SALT, MOST_SALTS = 4_000_000, 256


def profile_sets(spec: FactorSpec, cells: DataFrame, theta: float, reg: float, max_pools: int | None = None,
                 adaptive: bool = False) -> DataFrame:
    """Near-optimal partitions of every observed profile, all in one job (first half of R21).

    A profile may use what the others leave at best: theta minus their error
    lower bounds, and the pool budget minus one pool for each of them.
    """
    total = cells.agg(F.sum("n")).scalar()
    bounds = (cells.groupBy("profile_id").agg(F.sum("ssw").alias("_ssw"))
              .withColumn("_lb", F.col("_ssw") / total))
    every = cells.agg(F.sum("ssw") / F.sum("n")).scalar()
    bounds = bounds.withColumn("theta", F.lit(theta) + TOLERANCE - (every - F.col("_lb"))).select("profile_id", "theta")
    budget = None
    if max_pools is not None:
        observed = scalar(cells.agg(F.count_distinct("profile_id")))
        budget = max_pools - observed + 1
    if adaptive:
        return frontier_set(spec, cells, theta, reg, max_pools=budget, theta_by_profile=bounds)
    scored = score_space(spec, cells, reg, max_pools=budget)
    return scored.join(bounded(bounds, spec.n_profiles), "profile_id").where(F.col("q") <= F.col("theta")).drop("theta")


def combine(items: DataFrame, n_slots: int, theta: float, max_pools: int | None = None) -> DataFrame:
    """All choices of one item per slot whose losses sum to at most theta (R18, R19): one group of ``combine_by``.

    ``items`` has slot, q, h and members (an array).
    """
    limit = items.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(float(theta)).alias("theta"))
    return combine_by(items.withColumn("_all", F.lit(0)), ["_all"], n_slots, limit, max_pools).drop("_all")


def _merge_pairs(rows: DataFrame, n_slots: int, budget: bool, by: list[str], limits: list[str]) -> DataFrame:
    """One round: slots 2k and 2k + 1 become slot k; an odd last slot passes through.

    Rows meet within their ``by`` group only.  The excess losses of a pair's right side are cut into bands of about
    equal mass; a left row lists the bands it can still afford, so rows that meet are feasible but for the last band.
    Where a pair has many rows on both sides, its right rows are copied over salts, as many as the counts call for.
    """
    paired = n_slots // 2 * 2
    sided = rows.where(f"slot < {paired}").selectExpr("*", "slot div 2 as _pair", "slot % 2 = 1 as _right")
    shares = [k / BANDS for k in range(1, BANDS)]
    measured = sided.groupBy(*by, "_pair").agg(
        F.percentile_approx(F.when(F.col("_right"), F.col("excess")), shares, 1000).alias("_edges"),
        F.ceil(F.count_if("_right") * F.count_if(~F.col("_right")) / F.lit(PAIRS_PER_SALT)).alias("_heavy"))
    measured = measured.where("_edges is not null").selectExpr(*by, "_pair", "array_distinct(_edges) as _edges", f"cast(greatest(1, least(_heavy, {MOST_SALTS})) as int) as _salts")
    sided = sided.join(measured, [*by, "_pair"])
    left = (sided.where("not _right")
            .selectExpr(*by, *limits, "_pair", "explode(sequence(0, size(filter(_edges, e -> e < slack - excess)))) as _band", "cast(pmod(xxhash64(members), _salts) as int) as _salt",
                        "q as ql", "h as hl", "members as ml", "excess as el", "extra as xl"))
    right = (sided.where("_right")
             .selectExpr(*by, "_pair", "size(filter(_edges, e -> e < excess)) as _band", "explode(sequence(0, _salts - 1)) as _salt",
                         "q as qr", "h as hr", "members as mr", "excess as er", "extra as xr"))
    merged = (left.join(right, [*by, "_pair", "_band", "_salt"]).where("el + er <= slack")
              .selectExpr(*by, *limits, "cast(_pair as int) as slot", "ql + qr as q", "hl + hr as h", "concat(ml, mr) as members",
                          "el + er as excess", "xl + xr as extra"))
    if budget:
        merged = merged.where("extra <= spare")
    if paired < n_slots:
        merged = merged.unionByName(rows.where(f"slot = {paired}").withColumn("slot", F.lit(paired // 2)))
    return merged


def combine_by(items: DataFrame, by: list[str], n_slots: int, theta: DataFrame, max_pools: int | None = None) -> DataFrame:
    """All choices of one item per slot and group whose losses sum to at most the group's theta, and pools to ``max_pools``.

    ``items`` and ``theta`` (by, theta) carry the group's keys.  Measured from the best item of its slot, every item has
    an excess, and a combination is feasible when the excesses sum to at most the slack.  Slots are merged in pairs, so
    there are log2 rounds, and every kept row extends to a full model unless pools are limited.  Minima, slack and
    spare pools ride along as columns; nothing reaches the driver, however many slots there are.
    """
    items = materialize(items.select(*by, "slot", "q", "h", "members"), "items")
    best = items.groupBy(*by, "slot").agg(F.min("q").alias("_q"), F.min("h").cast("long").alias("_h"))
    limits = (best.groupBy(*by).agg(F.sum("_q").alias("_sum"), F.sum("_h").alias("_pools"), F.count("*").alias("_slots"))
              .join(theta.select(*by, "theta"), by).where((F.col("_slots") == n_slots) & (F.col("theta") - F.col("_sum") >= -TOLERANCE))
              .select(*by, "theta", (F.greatest(F.col("theta") - F.col("_sum"), F.lit(0.0)) + TOLERANCE).alias("slack"),
                      (F.lit(max_pools).cast("long") - F.col("_pools")).alias("spare")))
    rows = (items.join(best, [*by, "slot"]).join(limits, by)
            .select(*by, "theta", "slack", "spare", "slot", "q", "h", "members", (F.col("q") - F.col("_q")).alias("excess"), (F.col("h") - F.col("_h")).alias("extra"))
            .where("excess <= slack and coalesce(extra <= spare, true)"))
    rows = materialize(rows, "merged")
    discard(items)
    left_count = n_slots
    while left_count > 1:
        merged = _merge_pairs(rows, left_count, max_pools is not None, by, ["theta", "slack", "spare"])
        left_count = (left_count + 1) // 2
        if left_count > 1:
            merged = materialize(merged, "merged")
            discard(rows)
        rows = merged
    # losses were summed in another order than theta; this filter has no tolerance
    out = rows.where("q <= theta").select(*by, "q", "h", "members")
    return out if max_pools is None else out.where(F.col("h") <= max_pools)


def near_optimal_models_by(spec: FactorSpec, cells: DataFrame, by: list[str], theta: DataFrame, reg: float,
                           max_pools: int | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Models over all profiles for every outcome, configuration or other group of ``by``, each under its own theta.

    ``cells`` and ``theta`` carry the keys; ``scored`` may hand in the losses of the whole space.
    """
    scored = scored if scored is not None else score_space(spec, cells, reg, by=by)
    per = cells.groupBy(*by, "profile_id").agg(F.sum("ssw").alias("_ssw"), F.sum("n").alias("_n"))
    whole = per.groupBy(*by).agg(F.sum("_ssw").alias("_all"), F.sum("_n").alias("_total"), F.count("*").alias("_profiles"))
    limits = (per.join(whole, by).join(theta.select(*by, "theta"), by)
              .select(*by, "profile_id", (F.col("theta") - (F.col("_all") - F.col("_ssw")) / F.col("_total")).alias("_limit"),
                      (F.lit(max_pools).cast("long") - F.col("_profiles") + 1).alias("_budget")))
    sets = scored.join(limits, [*by, "profile_id"]).where(f"q <= _limit + {TOLERANCE!r}D and coalesce(h <= _budget, true)")
    items = sets.select(*by, F.col("profile_id").alias("slot"), "q", F.col("h").cast("long").alias("h"),
                        F.array(F.struct(F.col("profile_id"), F.col("cut_mask"))).alias("members"))
    blank = (cells.select(*by).distinct().selectExpr(*by, f"explode(sequence(0, {spec.n_profiles - 1})) as profile_id")
             .join(per.select(*by, "profile_id"), [*by, "profile_id"], "left_anti")
             .select(*by, F.col("profile_id").alias("slot"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("h"),
                     F.expr("cast(array() as array<struct<profile_id:int,cut_mask:bigint>>)").alias("members")))
    return model_table(combine_by(items.unionByName(blank), by, spec.n_profiles, theta, max_pools), by=by)


def model_table(combined: DataFrame, slot_field: str = "profile_id", by: list[str] = ()) -> DataFrame:
    """Name the combined rows: model_key, loss, n_pools, members."""
    ordered = F.array_sort("members")
    key = F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", m[slot_field].cast("string"), m["cut_mask"].cast("string"))), "|")
    return combined.select(*by, key.alias("model_key"), F.col("q").alias("loss"), F.col("h").alias("n_pools"),
                           ordered.alias("members"))


def near_optimal_models(spec: FactorSpec, cells: DataFrame, theta: float, reg: float,
                        max_pools: int | None = None, adaptive: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """The near-optimal models over all profiles (R21); ``sets`` may hand in the profile sets."""
    sets = sets if sets is not None else profile_sets(spec, cells, theta, reg, max_pools, adaptive)
    items = sets.select(F.col("profile_id").alias("slot"), "q", "h",
                        F.array(F.struct(F.col("profile_id"), F.col("cut_mask"))).alias("members"))
    observed = cells.select(F.col("profile_id").alias("slot")).distinct()
    blank = (cells.sparkSession.range(spec.n_profiles).select(F.col("id").cast("int").alias("slot"))
             .join(observed, "slot", "left_anti")
             .select("slot", F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("h"),
                     F.expr("cast(array() as array<struct<profile_id:int,cut_mask:bigint>>)").alias("members")))
    return model_table(combine(items.unionByName(blank), spec.n_profiles, theta, max_pools))


def stratified_scores(spec: FactorSpec, cells: DataFrame, stratum: str, reg: float, profile_id: int) -> DataFrame:
    """Losses of every partition in every stratum (R27), written once.  N is the row count over all strata, so they add up."""
    total = cells.agg(F.sum("n")).scalar()
    own = space_errors(spec, box_moments(spec, cells, [stratum]), [stratum], profile_id)
    return materialize(own.withColumn("_total", total).withColumn("q", F.col("sse") / F.col("_total") + F.lit(float(reg)) * F.col("h")).drop("_total"), "strata")


def stratified_models(spec: FactorSpec, scored: DataFrame, stratum: str, values: list, theta: float, max_pools: int | None = None) -> DataFrame:
    """One partition per stratum under one threshold (R27), from ``stratified_scores``.

    A stratum may use what the best of the others leave of theta, so most partitions go before they are combined.
    """
    best = scored.groupBy(stratum).agg(F.min("q").alias("_q"))
    kept = (scored.join(best, stratum).withColumn("_sum", best.agg(F.sum("_q")).scalar())
            .where(F.col("q") <= theta + TOLERANCE - (F.col("_sum") - F.col("_q"))))
    order = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
    unlisted = F.raise_error(F.concat(F.lit(f"{stratum} is not among the listed strata: "), F.coalesce(F.col(stratum).cast("string"), F.lit("null")))).cast("int")
    slot = F.coalesce(F.try_element_at(order, F.col(stratum)), unlisted)
    items = kept.select(slot.alias("slot"), "q", "h", F.array(F.struct(slot.alias("slot"), F.col("cut_mask"))).alias("members"))
    return model_table(combine(items, len(values), theta, max_pools), "slot")


def collapse_homogeneous(models_df: DataFrame, pooled_set: DataFrame, n_strata: int) -> DataFrame:
    """Replace models that use one partition in all strata by the pooled model, if that is in its set.

    Replaced models get slot -1 and the loss and size of the pooled model; the others, and equal ones without a pooled
    counterpart, stay as they are.
    """
    masks = F.array_distinct(F.transform("members", lambda m: m["cut_mask"]))
    flagged = models_df.withColumn("_one", F.when(F.size(masks) == 1, masks[0]))
    pooled = pooled_set.select(F.col("cut_mask").alias("_one"), F.lit(True).alias("_pooled"), F.col("q").alias("_q"), F.col("h").alias("_h"))
    joined = flagged.join(pooled, "_one", "left")
    is_pooled = F.coalesce(F.col("_pooled"), F.lit(False))
    return joined.select(F.when(is_pooled, F.concat(F.lit("-1:"), F.col("_one").cast("string")))
                         .otherwise(F.col("model_key")).alias("model_key"),
                         is_pooled.alias("is_pooled"), F.when(is_pooled, F.col("_q")).otherwise(F.col("loss")).alias("loss"),
                         F.when(is_pooled, F.col("_h")).otherwise(F.col("n_pools")).alias("n_pools"))


def model_members(models_df: DataFrame) -> DataFrame:
    """One row per (model, profile): the long form of the members."""
    return models_df.select("model_key", "loss", F.explode("members").alias("_m")).select("model_key", "loss", "_m.*")


def used_partitions(sets: DataFrame, models_df: DataFrame) -> DataFrame:
    """Partitions that occur in some model."""
    used = model_members(models_df).select("profile_id", "cut_mask")
    return sets.join(used, ["profile_id", "cut_mask"], "left_semi")


def usable_items(items: DataFrame, n_slots: int, theta: float, max_pools: int | None = None, slot: str = "profile_id") -> DataFrame:
    """Items (slot, q, h) that some model within theta and ``max_pools`` uses (R20), without making any model.

    Without a budget an item is usable if its excess over the best of its slot fits the slack.  With one, each slot has a
    front, the least loss of every pool count; fronts of slots are added up in pairs to the root, and what the
    others leave to each node comes down again, so 2 log2 rounds of joins on the pair see fronts only.
    """
    spark = items.sparkSession
    best = items.groupBy(slot).agg(F.min("q").alias("_q"))
    if max_pools is None:
        whole = best.agg(F.sum("_q").alias("_sum"), F.count("*").alias("_slots")).where((F.col("_slots") == n_slots) & (F.col("_sum") <= theta + TOLERANCE))
        return (items.join(best, slot).withColumn("_sum", whole.select("_sum").scalar())
                .where(F.col("q") - F.col("_q") <= theta + TOLERANCE - F.col("_sum")).drop("_q", "_sum"))
    places = running(best.select(slot), [], [slot], position="_place").withColumn("node", F.col("_place") - 1).drop("_place")
    placed = materialize(items.join(places, slot).withColumn("h", F.col("h").cast("long")), "placed")
    if placed.select("node").distinct().count() < n_slots:
        return items.where(F.lit(False))

    def front(rows: DataFrame) -> DataFrame:
        """The least loss per node and pool count; counts that fewer pools beat are dropped by the next sum's minimum."""
        return materialize(rows.where((F.col("h") <= max_pools) & (F.col("q") <= theta + TOLERANCE)).groupBy("node", "h").agg(F.min("q").alias("q")), "front")

    def added(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
        return a.alias("a").join(b.alias("b"), on).select("a.node", (F.col("a.h") + F.col("b.h")).alias("h"), (F.col("a.q") + F.col("b.q")).alias("q"))

    levels, count = [front(placed.select("node", "h", "q"))], n_slots
    while count > 1:
        below = levels[-1]
        pair = added(below.where("node % 2 = 0"), below.where("node % 2 = 1"), F.expr("b.node = a.node + 1"))
        alone = below.where(f"node = {count - 1}") if count % 2 else below.limit(0)
        levels.append(front(pair.unionByName(alone).withColumn("node", F.expr("node div 2"))))
        count = (count + 1) // 2
    others = spark.range(1).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("q"))
    for level, below in enumerate(reversed(levels[:-1])):
        top = -(-n_slots // 2 ** (len(levels) - 2 - level))
        children = others.selectExpr("explode(array(node * 2, node * 2 + 1)) as node", "h", "q").where(f"node < {top}")
        alone = children.where(f"node = {top - 1}") if top % 2 else children.limit(0)
        beside = added(children.where(f"node < {top - top % 2}"), below, F.expr("b.node = a.node + 1 - 2 * (a.node % 2)"))
        others = front(beside.unionByName(alone))
    fits = F.expr(f"a.node = b.node and a.h + b.h <= {max_pools} and a.q + b.q <= {theta + TOLERANCE!r}D")
    return placed.alias("a").join(others.alias("b"), fits, "left_semi").select(*[F.col(f"a.{c}") for c in items.columns])


def used_prefix(sets: DataFrame, models_df: DataFrame) -> DataFrame:
    """Per profile, the loss-ordered prefix up to the last used partition (R20, prefix form)."""
    used = model_members(models_df).select("profile_id", "cut_mask").distinct()
    last = (sets.join(used, ["profile_id", "cut_mask"]).groupBy("profile_id")
            .agg(F.max(F.round("q", 12)).alias("_last")))
    return sets.join(last, "profile_id").where(F.round("q", 12) <= F.col("_last")).drop("_last")


def model_summary(models_df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Best model, its loss and the relative spread of the set (R23), of each group."""
    return models_df.groupBy(*by).agg(F.count("*").alias("n_models"), F.min("loss").alias("q0"),
                         F.try_divide(F.max("loss") - F.min("loss"), F.min("loss")).alias("eps"),
                         F.min_by("model_key", F.struct(F.round("loss", 12), "model_key")).alias("map_model"))


def prune_by_epsilon(models_df: DataFrame, eps: float, loss: str = "loss") -> DataFrame:
    """Models within a relative distance of the best one."""
    best = models_df.agg(F.min(loss)).scalar()
    return models_df.where(F.col(loss) <= best * (1 + eps))


def global_pool_ids(pools: DataFrame) -> DataFrame:
    """Pools over all profiles with one integer id (R17): the place of (profile, pool) in their order, found by ranges."""
    names = pools.select("profile_id", "pool_id").distinct()
    placed = running(names, [], ["profile_id", "pool_id"], position="_place")
    return pools.join(placed, ["profile_id", "pool_id"]).withColumn("global_pool", (F.col("_place") - 1).cast("int")).drop("_place")


def describe_pools(spec: FactorSpec, assignment: DataFrame) -> DataFrame:
    """Cells and mean of each pool of chosen models (R29); ``assignment`` has policy_id, pool key and mean."""
    return (assignment.groupBy("profile_id", "cut_mask", "pool_id")
            .agg(F.array_sort(F.collect_list("policy_id")).alias("policies"), F.first("mean_y").alias("mean_y"),
                 F.first("n").alias("n")))
