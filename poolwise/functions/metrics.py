"""Accuracy of fitted effects against a truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.runtime import bounded
from poolwise.spec import FactorSpec


def mean_squared_error(rows: DataFrame, truth: str, estimate: str, by: list[str] = ()) -> DataFrame:
    """M1."""
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(truth) - F.col(estimate), F.lit(2.0))).alias("mse"))


def best_policies(cells: DataFrame, column: str, by: list[str] = (), digits: int | None = None) -> DataFrame:
    """Every observed cell that ties with the largest value (M2).

    The maximum is a partial aggregate that the cells meet by key, so no group
    is sorted or gathered.
    """
    by = list(by)
    df = cells if digits is None else cells.withColumn(column, F.round(column, digits))
    if not by:
        return df.where(F.col(column) == df.agg(F.max(column)).scalar())
    top = df.groupBy(*by).agg(F.max(column).alias("_top"))
    return df.join(top, by).where(F.col(column) == F.col("_top")).drop("_top")


def intersection_over_union(a: DataFrame, b: DataFrame, key: str = "policy_id", by: list[str] = ()) -> DataFrame:
    """Size of the intersection over size of the union of two sets (M3)."""
    by = list(by)
    left = a.select(*by, key).distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
    right = b.select(*by, key).distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    keyed = left.unionByName(right).groupBy(*by, key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return keyed.groupBy(*by).agg((F.sum(F.col("_a") * F.col("_b")) / F.count("*")).alias("iou"))


def min_dosage(policies: DataFrame, levels: list[str], by: list[str] = ()) -> DataFrame:
    """Members of a set with the smallest level sum, ties kept (M4)."""
    dose = sum((F.col(c) for c in levels[1:]), F.col(levels[0]))
    df = policies.withColumn("dosage", dose.cast("long"))
    by = list(by)
    if not by:
        return df.where(F.col("dosage") == df.agg(F.min("dosage")).scalar())
    low = df.groupBy(*by).agg(F.min("dosage").alias("_low"))
    return df.join(low, by).where(F.col("dosage") == F.col("_low")).drop("_low")


def shares_member(a: DataFrame, b: DataFrame, key: str = "policy_id") -> DataFrame:
    """Whether two sets have a common element (M5)."""
    return a.select(key).join(b.select(key), key, "left_semi").agg((F.count("*") > 0).alias("shares_member"))


def best_effect_gap(truth: DataFrame, estimate: DataFrame, truth_col: str, estimate_col: str) -> DataFrame:
    """Largest true value minus largest estimate (M6)."""
    return (truth.agg(F.max(truth_col).alias("best_true"))
            .withColumn("best_estimate", estimate.agg(F.max(estimate_col)).scalar())
            .withColumn("gap", F.col("best_true") - F.col("best_estimate")))


def profile_indicator(spec: FactorSpec, policies: DataFrame, by: list[str] = ()) -> DataFrame:
    """0/1 column per profile: does the set hold a cell of it (M7)."""
    df = policies.withColumn("_p", spec.profile_of_policy())
    return df.groupBy(*by).agg(*[F.max((F.col("_p") == p).cast("int")).alias(f"profile_{p}") for p in range(spec.n_profiles)])


def profiles_of(spec: FactorSpec, policies: DataFrame, by: list[str] = ()) -> DataFrame:
    """Profiles whose cells a set holds, one row each (M7, long form): for designs with many profiles."""
    return policies.select(*by, spec.profile_of_policy().alias("profile_id")).distinct()


def model_metrics(spec: FactorSpec, models_df: DataFrame, sets: DataFrame, boxes: DataFrame, cells: DataFrame, true_best: DataFrame,
                  min_dose: DataFrame, true_effect: Column | float, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """M1-M6 for every model over all profiles, and the profiles in which each has its best cells (M8 with M7).

    The best pools of a partition are described once; a model takes those of its partitions whose estimate is the largest.
    """
    keys = ["profile_id", "cut_mask"]
    per = partition_metrics(spec, sets, boxes, cells, true_best, min_dose, true_effect, digits, parts=True)
    total, n_true = cells.agg(F.sum("n")).scalar(), true_best.agg(F.count("*")).scalar()
    members = models_df.select("model_key", "n_pools", F.explode("members").alias("_m")).select("model_key", "n_pools", "_m.*")
    sides = members.join(per, keys).withColumn("_key", F.round("best_estimate", digits))
    top = sides.groupBy("model_key", "n_pools").agg(F.max("_key").alias("_top"), F.sum("sse").alias("_sse"))
    best = sides.join(top.select("model_key", "_top", "_sse"), "model_key").where(F.col("_key") == F.col("_top"))
    scored = (best.groupBy("model_key", "n_pools", "_sse")
              .agg(F.max("best_estimate").alias("best_estimate"), F.sum("n_best").alias("n_best"), F.sum("_hit").alias("_hit"), F.max("_min").alias("_min")))
    effect = true_effect if isinstance(true_effect, Column) else F.lit(float(true_effect))
    scored = (scored.withColumns({"_total": total, "_true": n_true, "_effect": effect})
              .select("model_key", "n_pools", *_scores("_sse")))
    return scored, best.select("model_key", "profile_id")


def _scores(sse: str) -> list[Column]:
    return [(F.col(sse) / F.col("_total")).alias("mse"), (F.col("_hit") / (F.col("n_best") + F.col("_true") - F.col("_hit"))).alias("iou"),
            (F.col("_min") > 0).alias("min_dosage_hit"), (F.col("_effect") - F.col("best_estimate")).alias("best_gap")]


def partition_metrics(spec: FactorSpec, scored: DataFrame, boxes: DataFrame, cells: DataFrame,
                      true_best: DataFrame, min_dose: DataFrame, true_effect: Column | float,
                      digits: int = 9, parts: bool = False) -> DataFrame:
    """M1-M6 for every partition of a set of one profile (M8); ``parts`` returns the counts they are made of.

    A partition's best cells are the observed cells of its best pool, so only
    that pool is unfolded into cells.  The truth sets are tables of cells; how
    many of their members lie in a pool is counted by an equi-join on cell.
    """
    means = bounded(boxes.select("box_id", "mean_y"), spec.n_boxes)
    pools = spec.mask_boxes(scored.select("profile_id", "cut_mask", "h", "sse")).join(means, "box_id")
    keys = ["profile_id", "cut_mask"]
    pools = pools.withColumn("_key", F.round("mean_y", digits))
    best = best_policies(pools, "_key", by=keys).withColumnRenamed("mean_y", "best_estimate").drop("_key")
    obs = bounded(cells.select("policy_id"), spec.n_policies)
    flags = (true_best.select("policy_id", F.lit(1).alias("is_best"), F.lit(0).alias("is_min"))
             .unionByName(min_dose.select("policy_id", F.lit(0).alias("is_best"), F.lit(1).alias("is_min")))
             .groupBy("policy_id").agg(F.max("is_best").alias("is_best"), F.max("is_min").alias("is_min")))
    unfolded = (spec.box_policies(best).join(obs, "policy_id")
                .join(bounded(flags, spec.n_policies), "policy_id", "left").fillna(0, ["is_best", "is_min"]))
    total = cells.agg(F.sum("n")).scalar()
    n_true = true_best.agg(F.count("*")).scalar()
    out = (unfolded.groupBy(*keys, "h", "sse")
           .agg(F.max("best_estimate").alias("best_estimate"), F.count("*").alias("n_best"), F.sum("is_best").alias("_hit"), F.max("is_min").alias("_min")))
    if parts:
        return out
    effect = true_effect if isinstance(true_effect, Column) else F.lit(float(true_effect))
    return out.withColumns({"_total": total, "_true": n_true, "_effect": effect}).select(*keys, "h", *_scores("sse"))


def treatment_effect_metrics(effects: DataFrame, key: str, truth: str, estimate: str, digits: int = 9) -> DataFrame:
    """Error of treatment effects, of the largest one, and overlap of the arg-max sets (M9)."""
    df = effects.select(key, F.round(truth, digits).alias("_t"), F.round(estimate, digits).alias("_e"), truth, estimate)
    df = df.withColumns({"_mt": df.agg(F.max("_t")).scalar(), "_me": df.agg(F.max("_e")).scalar()})
    in_t, in_e = F.col("_t") == F.col("_mt"), F.col("_e") == F.col("_me")
    both = F.count_if(in_t & in_e)
    return df.agg(F.avg(F.pow(F.col(truth) - F.col(estimate), F.lit(2.0))).alias("mse_te"),
                  (F.max(truth) - F.max(estimate)).alias("max_te_err"),
                  (both / F.count_if(in_t | in_e)).alias("iou"))


def sign_confusion(effects: DataFrame, truth: str, estimate: str) -> DataFrame:
    """3 x 3 table of true by estimated sign, rows normalised, empty rows zero."""
    spark = effects.sparkSession
    grid = spark.range(9).select((F.floor(F.col("id") / 3) - 1).cast("int").alias("true_sign"),
                                 (F.col("id") % 3 - 1).cast("int").alias("est_sign"))
    counts = (effects.groupBy(F.signum(truth).cast("int").alias("true_sign"), F.signum(estimate).cast("int").alias("est_sign"))
              .agg(F.count("*").alias("_n")))
    rows = counts.groupBy("true_sign").agg(F.sum("_n").alias("_row"))
    return (grid.join(F.broadcast(counts), ["true_sign", "est_sign"], "left").join(F.broadcast(rows), "true_sign", "left")
            .select("true_sign", "est_sign", F.coalesce(F.col("_n") / F.col("_row"), F.lit(0.0)).alias("share")))
