"""Checks of partitions that come from elsewhere, as (partition_id, pool_id, policy_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwise.operators.design import lattice_edges
from poolwise.runtime import bounded, materialize
from poolwise.spec import FactorSpec


def _extent(spec: FactorSpec, assign: DataFrame) -> DataFrame:
    aggs = [F.count("*").alias("n_cells")]
    for i in range(spec.m):
        lev = spec.level(i)
        aggs += [F.min(lev).alias(f"_lo{i}"), F.max(lev).alias(f"_hi{i}")]
    return assign.groupBy("partition_id", "pool_id").agg(*aggs)


def box_check(spec: FactorSpec, assign: DataFrame) -> DataFrame:
    """Whether each pool fills its bounding box (F1), by counting."""
    volume = F.lit(1)
    for i in range(spec.m):
        volume = volume * (F.col(f"_hi{i}") - F.col(f"_lo{i}") + 1)
    return (_extent(spec, assign).withColumn("volume", volume.cast("long"))
            .select("partition_id", "pool_id", "n_cells", "volume", (F.col("volume") == F.col("n_cells")).alias("is_box")))


def permissible(spec: FactorSpec, assign: DataFrame) -> DataFrame:
    """Whether all pools are boxes and each one-factor merge repeats for all settings of the others (F2).

    Per factor and level step, the lattice edges must be all inside pools or
    all across pools.
    """
    boxes = box_check(spec, assign).groupBy("partition_id").agg(F.bool_and("is_box").alias("all_boxes"))
    edges = bounded(lattice_edges(assign.sparkSession, spec), spec.n_policies * spec.m)
    src = assign.select("partition_id", F.col("policy_id").alias("src"), F.col("pool_id").alias("_p"))
    dst = assign.select("partition_id", F.col("policy_id").alias("dst"), F.col("pool_id").alias("_q"))
    steps = (src.join(edges, "src").join(dst, ["partition_id", "dst"])
             .groupBy("partition_id", "profile_id", "factor", "lower_level")
             .agg((F.min((F.col("_p") == F.col("_q")).cast("int")) == F.max((F.col("_p") == F.col("_q")).cast("int"))).alias("_even"))
             .groupBy("partition_id").agg(F.bool_and("_even").alias("_even")))
    return (boxes.join(steps, "partition_id", "left")
            .select("partition_id", "all_boxes", (F.col("all_boxes") & F.coalesce("_even", F.lit(True))).alias("is_permissible")))


def external_boxes(spec: FactorSpec, assign: DataFrame) -> DataFrame:
    """(partition_id, box_id) of the pools of external partitions; null for a pool that is no box."""
    volume, code = F.lit(1), F.lit(0).cast("long")
    for i in range(spec.m):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        volume = volume * (hi - lo + 1)
        inner = F.when(hi > 0, lo * spec.levels[i] + hi).otherwise(F.lit(0)).cast("long")
        code = code + inner * F.lit(spec.box_strides[i]).cast("long")
    return _extent(spec, assign).select("partition_id", F.when(volume == F.col("n_cells"), code).alias("box_id"))


def _prints(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Number of boxes of each partition and 128 bits that do not depend on their order."""
    second = F.xxhash64("box_id", F.lit("second"))
    return boxes.groupBy(*by).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("box_id")).alias("_one"), F.bit_xor(second).alias("_two"), F.count("box_id").alias("_boxes"))


def overlap_with_set(spec: FactorSpec, assign: DataFrame, partitions: DataFrame) -> DataFrame:
    """External partitions that equal some partition of the set.

    Partitions are paired by the fingerprints of their boxes, which add up map-side, so no row holds all boxes of a
    partition; then the boxes of each pair are compared one by one, so no fingerprint decides.
    """
    theirs = materialize(external_boxes(spec, assign), "boxes")
    ours = spec.mask_boxes(partitions.select("profile_id", "cut_mask").distinct())
    print_of = ["_n", "_one", "_two"]
    pairs = _prints(theirs, ["partition_id"]).where("_n = _boxes").join(_prints(ours, ["profile_id", "cut_mask"]), print_of)
    pairs = materialize(pairs.select("partition_id", "profile_id", "cut_mask", "_n"), "pairs")
    chosen = spec.mask_boxes(pairs)
    same = chosen.join(theirs, ["partition_id", "box_id"]).groupBy("partition_id", "profile_id", "cut_mask", "_n").agg(F.count("*").alias("_same"))
    return same.where("_same = _n").select("partition_id").distinct()


def replicate_means(results: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean of each result over the replicates of a setting."""
    return results.groupBy(*by).agg(F.count("*").alias("n_replicates"), *[F.avg(c).alias(c) for c in columns])
