"""Summaries over a set of scored models, weighted by exp(-loss)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.groups import attach
from poolwise.functions.running import running
from poolwise.operators.prep import quantiles
from poolwise.runtime import bounded, materialize
from poolwise.spec import FactorSpec


def weights(scored: DataFrame, loss: str = "q", by: list[str] = (), normalise: bool = True) -> DataFrame:
    """weight = exp(-loss), shifted by the best loss so it cannot underflow (B1)."""
    by = list(by)
    df = attach(scored, by, _best=F.min(loss)).withColumn("weight", F.exp(F.col("_best") - F.col(loss))).drop("_best")
    if normalise:
        df = attach(df, by, _sum=F.sum("weight")).withColumn("weight", F.col("weight") / F.col("_sum")).drop("_sum")
    return df


def ratios(weighted: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weight against the best model: ratio, relative gap, and scaled to [0, 1] (B2)."""
    df = attach(weighted, list(by), _hi=F.max("weight"), _lo=F.min("weight"))
    span = F.col("_hi") - F.col("_lo")
    return (df.withColumn("to_map", F.col("weight") / F.col("_hi"))
            .withColumn("gap", (F.col("weight") - F.col("_hi")) / F.col("_hi"))
            .withColumn("scaled", F.when(span > 0, (F.col("weight") - F.col("_lo")) / span).otherwise(F.lit(1.0)))
            .drop("_hi", "_lo"))


def partition_weights(members: DataFrame, weight: str = "weight") -> DataFrame:
    """Total weight of the models that use each partition.

    Later steps then cost as much as the distinct partitions, not the models.
    """
    return members.groupBy("profile_id", "cut_mask").agg(F.sum(weight).alias("weight"))


def posterior_effects(spec: FactorSpec, weighted_partitions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Weighted mean over the set of each cell's pool mean.

    Weights are summed per box before boxes meet their cells, so the join is
    of design size however many models there are.
    """
    per_box = (spec.mask_boxes(weighted_partitions.select("profile_id", "cut_mask", "weight"))
               .groupBy("box_id").agg(F.sum("weight").alias("_w")))
    means = bounded(boxes.select("box_id", "mean_y"), spec.n_boxes)
    spread = spec.box_policies(per_box.join(means, "box_id", "left").fillna(0.0, ["mean_y"]))
    return (spread.groupBy("policy_id")
            .agg((F.sum(F.col("_w") * F.col("mean_y")) / F.sum("_w")).alias("beta"), F.sum("_w").alias("mass")))


def stratified_effects(spec: FactorSpec, models: DataFrame, values: list, stratum: str, own_boxes: DataFrame, pooled_boxes: DataFrame,
                       profile_id: int) -> DataFrame:
    """Weighted mean per stratum and cell over stratified models (B3), weights exp(best loss - loss).

    Keys of ``models`` name the mask of each stratum by its place in ``values``, or once, as ``-1``, the mask of a model
    that serves all strata; such a model speaks with the means of all strata together (``pooled_boxes``).
    """
    per = _stratum_masks(models, values, stratum, profile_id)
    per_box = spec.mask_boxes(per).groupBy(stratum, "_pooled", "box_id").agg(F.sum("weight").alias("_w"))
    shared = bounded(pooled_boxes.select("box_id", "mean_y"), spec.n_boxes)
    means = (per_box.where("not _pooled").join(own_boxes.select(stratum, "box_id", "mean_y"), [stratum, "box_id"], "left")
             .unionByName(per_box.where("_pooled").join(shared, "box_id", "left")).fillna(0.0, ["mean_y"]))
    return (spec.box_policies(means).groupBy(stratum, "policy_id")
            .agg((F.sum(F.col("_w") * F.col("mean_y")) / F.sum("_w")).alias("beta"), F.sum("_w").alias("mass")))


def top_cells(effects: DataFrame, k: int, best: bool = True, column: str = "beta", digits: int = 9) -> DataFrame:
    """The k best or worst cells, ties by cell."""
    key = F.round(column, digits)
    return effects.orderBy(key.desc() if best else key.asc(), "policy_id").limit(k)


def effect_error(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """L2 distance between two cell-effect tables (B5).  A cell that one table lacks has effect 0 there, as a pool without data has."""
    both = estimate.select("policy_id", F.col("beta").alias("_a")).join(truth.select("policy_id", F.col("beta").alias("_b")), "policy_id", "full")
    apart = F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return both.agg(F.sqrt(F.coalesce(F.sum(apart * apart), F.lit(0.0))).alias("l2_error"))


def contains_partition(scored: DataFrame, profile_id: int, cut_mask: int) -> DataFrame:
    """Whether the set holds a given partition."""
    hit = (F.col("profile_id") == profile_id) & (F.col("cut_mask") == cut_mask)
    return scored.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


def split_frequency(spec: FactorSpec, partitions: DataFrame, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """Share of models that cut a factor between two levels (B6): one row per (factor, position).

    All shares are columns of one aggregation; only its result is unpivoted.
    """
    by = list(by)
    w = F.lit(1.0) if weight is None else weight
    cols, labels = [], []
    for i, name in enumerate(spec.names):
        for j in range(spec.bits[i]):
            bit = F.expr(f"shiftright(cut_mask, {spec.offsets[i] + j}) & 1L")
            cols.append((F.sum(w * bit) / F.sum(w)).alias(f"_s{i}_{j}"))
            labels.append(F.struct(F.lit(name).alias("factor"), F.lit(j).alias("position"), F.col(f"_s{i}_{j}").alias("share")))
    wide = partitions.groupBy(*by).agg(*cols)
    return wide.select(*by, F.explode(F.array(*labels)).alias("_x")).select(*by, "_x.*")


def factor_pooled_frequency(spec: FactorSpec, partitions: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of models in which a factor has any merge."""
    by = list(by)
    cols, labels = [], []
    for i, name in enumerate(spec.names):
        if spec.bits[i] == 0:
            continue
        cols.append(F.expr(f"avg(if({spec.factor_mask_sql(i)} != {spec.full_mask(i)}L, 1.0D, 0.0D)) as _p{i}"))
        labels.append(F.struct(F.lit(name).alias("factor"), F.col(f"_p{i}").alias("share")))
    wide = partitions.groupBy(*by).agg(*cols)
    return wide.select(*by, F.explode(F.array(*labels)).alias("_x")).select(*by, "_x.*")


def effects_vs_base(spec: FactorSpec, partitions: DataFrame, boxes: DataFrame, keep: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Effect of each level against level 1, per model and factor.

    Cells of one pool share their effect: the other factors' segments are the
    same, so the base cell lies in the pool's neighbour along that factor.  A
    row therefore stands for (model, pool, factor, level) and ``n_cells`` says
    for how many cells it speaks.
    """
    keep, by = list(keep), list(by)
    spread = spec.mask_boxes(partitions.select(*by, "profile_id", "cut_mask", *keep))
    means = bounded(boxes.select(*by, "box_id", "mean_y"), spec.n_boxes, by)
    steps = []
    for i, name in enumerate(spec.names):
        base = f"box_id + {spec.segments_sql(i)}[0] - {spec.box_code_sql(i)} * {spec.box_strides[i]}L"
        cells = f"({spec.box_volume_sql()}) div {spec.box_width_sql(i)}"
        steps.append(f"transform(filter({spec.box_levels_sql(i)}, l -> l > 1), l -> "
                     f"named_struct('factor', '{name}', 'level', l, 'base_box', {base}, 'n_cells', {cells}))")
    rows = spread.selectExpr(*by, "profile_id", "cut_mask", *keep, "box_id", f"inline(flatten(array({', '.join(steps)})))")
    base_means = means.select(*by, F.col("box_id").alias("base_box"), F.col("mean_y").alias("_base"))
    return (rows.join(means, by + ["box_id"], "left").join(base_means, by + ["base_box"], "left")
            .withColumn("effect", F.coalesce("mean_y", F.lit(0.0)) - F.coalesce("_base", F.lit(0.0)))
            .drop("mean_y", "_base"))


def stratified_effects_vs_base(spec: FactorSpec, models: DataFrame, values: list, stratum: str, own_boxes: DataFrame, pooled_boxes: DataFrame,
                               profile_id: int) -> DataFrame:
    """Effect of each level against level 1 per stratum (B8), over stratified models, collapsed ones included.

    Rows are those of ``effects_vs_base`` with the stratum, whether the mask is that of a model for all strata (``pooled``), and
    the ``weight`` of the models that use it; a pooled mask speaks in every stratum, with the means of all together.
    """
    parts = _stratum_masks(models, values, stratum, profile_id)
    own = effects_vs_base(spec, parts.where("not _pooled"), own_boxes, keep=["weight"], by=[stratum]).withColumn("pooled", F.lit(False))
    masks = parts.where("_pooled").select("profile_id", "cut_mask", "weight").distinct()
    shared = effects_vs_base(spec, masks, pooled_boxes, keep=["weight"]).select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(stratum), F.lit(True).alias("pooled"))
    return own.unionByName(shared)


def _stratum_masks(models: DataFrame, values: list, stratum: str, profile_id: int) -> DataFrame:
    """(stratum, _pooled, cut_mask, weight, profile_id): the masks that models name for each stratum, weights exp(best loss - loss)."""
    weighted = models.withColumn("_best", models.agg(F.min("loss")).scalar())
    parts = (weighted.select(F.exp(F.col("_best") - F.col("loss")).alias("weight"), F.explode(F.split("model_key", "[|]")).alias("_p"))
             .selectExpr("weight", "cast(split_part(_p, ':', 1) as int) as _slot", "cast(split_part(_p, ':', 2) as bigint) as cut_mask"))
    strata = F.array(*[F.lit(v) for v in values])
    named = F.when(F.col("_slot") < 0, strata).otherwise(F.array(F.get(strata, F.col("_slot"))))
    return (parts.groupBy("_slot", "cut_mask").agg(F.sum("weight").alias("weight"))
            .select(F.explode(named).alias(stratum), (F.col("_slot") < 0).alias("_pooled"), "cut_mask", "weight", F.lit(profile_id).alias("profile_id")))


def spread_of(effects: DataFrame, by: list[str], count: str = "n_cells") -> DataFrame:
    """Population standard deviation and mean of effects that stand for ``count`` cells each."""
    apart = F.col("effect") - F.col("_mean")
    centred = attach(effects, by, _mean=F.try_divide(F.sum(F.col(count) * F.col("effect")), F.sum(count)))
    return centred.groupBy(*by).agg(F.sqrt(F.try_divide(F.sum(F.col(count) * apart * apart), F.sum(count))).alias("sigma"))


def sigma_bin(effect: Column, sigma: Column, bins: int = 5) -> Column:
    """Bin of an effect by multiples of sigma (B9); the middle bin is exactly zero."""
    if bins == 3:
        return F.when(effect > 0, 0).when(effect == 0, 1).otherwise(2)
    return (F.when(effect == 0, 2).when(effect >= 2 * sigma, 0).when(effect > 0, 1)
            .when(effect >= -2 * sigma, 3).otherwise(4))


def effect_histogram(effects: DataFrame, by: list[str], scale_by: list[str], weight: str = "weight",
                     count: str = "n_cells", bins: int = 5) -> DataFrame:
    """Share of weight in each sigma bin per group (B10), one column per bin; without ``scale_by`` one sigma serves all."""
    sigma = spread_of(effects, scale_by, count)
    scaled = effects.join(sigma, scale_by) if scale_by else effects.withColumn("sigma", sigma.scalar())
    df = scaled.withColumn("_bin", sigma_bin(F.col("effect"), F.col("sigma"), bins))
    mass = F.col(weight) * F.col(count)
    total = F.sum(mass)
    return df.groupBy(*by).agg(*[F.try_divide(F.sum(F.when(F.col("_bin") == b, mass).otherwise(0.0)), total).alias(f"bin_{b}")
                                 for b in range(bins)])


def sign_shares(effects: DataFrame, by: list[str], count: str = "n_cells") -> DataFrame:
    """Fractions of positive, zero and negative effects."""
    n = F.sum(count)
    share = lambda cond: F.sum(F.when(cond, F.col(count)).otherwise(0)) / n
    e = F.col("effect")
    return effects.groupBy(*by).agg(share(e > 0).alias("positive"), share(e == 0).alias("zero"), share(e < 0).alias("negative"))


def equal_width_bin(column: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based index of the equal-width bin; the top edge belongs to the last bin."""
    idx = F.floor((column - lo) / (hi - lo) * bins)
    return F.when(hi > lo, F.least(idx, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def loss_histogram(scored: DataFrame, bins: int, column: str = "q") -> DataFrame:
    """Counts over equal-width bins of the loss."""
    df = scored.withColumns({"_lo": scored.agg(F.min(column)).scalar(), "_hi": scored.agg(F.max(column)).scalar()})
    return (df.groupBy(equal_width_bin(F.col(column), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
            .agg(F.count("*").alias("n_models")))


def size_histogram(scored: DataFrame, size: str = "h", weight: str = "weight") -> DataFrame:
    """Models and weight per number of pools."""
    return scored.groupBy(size).agg(F.count("*").alias("n_models"), F.sum(weight).alias("weight"))


def size_weight_histogram(weighted: DataFrame, bins: int, size: str = "h", weight: str = "weight") -> DataFrame:
    """Two-way counts: pools by equal-width weight bin."""
    df = weighted.withColumns({"_lo": weighted.agg(F.min(weight)).scalar(), "_hi": weighted.agg(F.max(weight)).scalar()})
    return (df.groupBy(F.col(size), equal_width_bin(F.col(weight), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
            .agg(F.count("*").alias("n_models")))


def approximation_error(scored: DataFrame, space_size: int, by: list[str] = (), digits: int = 12) -> DataFrame:
    """Error bounds of stopping after the k best models.

    With p the posterior of model k: mass = p k, 2 (1 - mass), 2 p (S - k), and
    the least of both and 1; ``hyperbola`` is 1 / mass - mass.
    """
    df = weights(scored, by=by).withColumn("_key", F.round("q", digits))
    df = running(df, list(by), ["_key", "cut_mask"], position="set_size").drop("_key")
    df = df.withColumn("mass", F.col("weight") * F.col("set_size"))
    df = attach(df, list(by), _best=F.min("q")).withColumn("epsilon", F.try_divide(F.col("q"), F.col("_best")) - 1).drop("_best")
    df = df.withColumn("error", 2 * (1 - F.col("mass")))
    df = df.withColumn("error2", 2 * F.col("weight") * (F.lit(space_size) - F.col("set_size")))
    return (df.withColumn("error_best", F.least("error", "error2", F.lit(1.0)))
            .withColumn("hyperbola", F.try_divide(F.lit(1.0), F.col("mass")) - F.col("mass")))


def cumulative_mass(scored: DataFrame, by: list[str] = (), digits: int = 12) -> DataFrame:
    """Running posterior mass, its lag ratio and the first difference of that ratio."""
    by = list(by)
    df = weights(scored, by=by).withColumn("_key", F.round("q", digits))
    df = running(df, by, ["_key", "cut_mask"], sums={"cum_mass": "weight"}, position="position")
    df = materialize(df.withColumn("ratio", F.col("weight") / F.col("cum_mass")), "mass")
    prior = df.select(*by, (F.col("position") + 1).alias("position"), F.col("ratio").alias("_prior"))
    return (df.join(prior, by + ["position"], "left")
            .withColumn("ratio_step", F.col("ratio") - F.col("_prior")).drop("_prior", "_key"))


def category_summary(effects: DataFrame, category: Column, by: list[str] = (), column: str = "beta", shares: Sequence[float] = (0.5,)) -> DataFrame:
    """Distribution of cell effects per coarser category.

    ``quantiles`` has the exact quantiles at ``shares``, found by ranges, so a heavy category is spread over tasks; the
    median stands alone too where it is among them.
    """
    by = ["category", *by]
    rows = materialize(effects.withColumn("category", category), "categories")
    found = quantiles(rows, column, shares, by)
    whole = rows.groupBy(*by).agg(F.count("*").alias("n_cells"), F.avg(column).alias("mean_effect"), F.min(column).alias("min_effect"), F.max(column).alias("max_effect"))
    same = [F.col(f"w.{b}").eqNullSafe(F.col(f"q.{b}")) for b in by]
    joined = whole.alias("w").join(found.alias("q"), same, "left").select("w.*", "q.quantiles")
    return joined.withColumn("median_effect", F.get("quantiles", F.lit(list(shares).index(0.5)))) if 0.5 in shares else joined
