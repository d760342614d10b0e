"""Ranks and running totals over orders that may be long.

A window with a whole-table order runs in one task, and one over a heavy group
nearly so.  Here rows are range-partitioned on (group, order) first; each range
ranks and sums its own rows, and ranges are shifted by the totals of those
before them.  A group of any size is thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwise.runtime import materialize


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, Column | str] | None = None,
            position: str | None = "position") -> DataFrame:
    """Add the 1-based rank and running sums inside each group.

    ``order`` must be total (end it with a key) and ascending column names, or
    columns ``F.desc(..)`` / ``F.asc(..)``.
    """
    sums = sums or {}
    keys = [F.col(b) for b in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.withColumns({f"_v_{k}": (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}) if sums else df
    # adaptive execution may merge neighbouring ranges, which keeps their order
    ranged = materialize(ranged.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")

    total = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_count"), *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    # one row per (group, range it touches): at most groups + ranges rows
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = total.select(*by, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_shift"),
                         *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_shift_{k}") for k in sums])
    inner = Window.partitionBy(*by, "_range").orderBy(*keys[len(by):])
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", F.row_number().over(inner).alias("_pos"), *[F.sum(f"_v_{k}").over(upto).alias(f"_r_{k}") for k in sums])
    # null-safe, since a grouping column may hold nulls
    cond = [ranged_col.eqNullSafe(F.col(f"_s_{b}")) for b, ranged_col in [(b, F.col(b)) for b in by]]
    shift = shift.select(*[F.col(b).alias(f"_s_{b}") for b in by], F.col("_range").alias("_s_range"),
                         F.col("_shift"), *[F.col(f"_shift_{k}") for k in sums])
    joined = out.join(shift, [F.col("_range") == F.col("_s_range"), *cond], "left")
    result = [c for c in df.columns]
    extra = [(F.col("_pos") + F.col("_shift")).alias(position)] if position else []
    extra += [(F.col(f"_r_{k}") + F.col(f"_shift_{k}")).alias(k) for k in sums]
    return joined.select(*result, *extra)
