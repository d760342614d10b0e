"""Analytics over tables of results: one row per (setting, replicate, model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwise.functions.groups import attach
from poolwise.functions.running import running


def summarise(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """min / mean / max / sample variance of each column per group (A1)."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.var_samp(c).alias(f"{c}_var")]
    return df.groupBy(*by).agg(*aggs)


def broadcast_summary(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The same four values next to every row (A1)."""
    return attach(df, by, **{f"{column}_min": F.min(column), f"{column}_mean": F.avg(column),
                             f"{column}_max": F.max(column), f"{column}_var": F.var_samp(column)})


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (A2), as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def two_level_mean(df: DataFrame, outer: list[str], inner: list[str], columns: list[str]) -> DataFrame:
    """Mean over groups of the means inside them (A3)."""
    per = df.groupBy(*outer, *inner).agg(*[F.avg(c).alias(c) for c in columns])
    return per.groupBy(*outer).agg(*[F.avg(c).alias(c) for c in columns])


def best_row(df: DataFrame, by: list[str], column: str, tie: str) -> DataFrame:
    """The row with the least value per group (A4)."""
    return first_per_key(df, by, [column, tie])


def derived_columns(df: DataFrame, reg: float, mse: str = "mse", pools: str = "num_pools", gap: str = "gap",
                    part: str = "n_set", whole: str = "n_total") -> DataFrame:
    """Loss, squared gap and fraction kept (A5)."""
    return (df.withColumn("loss", F.col(mse) + F.lit(reg) * F.col(pools))
            .withColumn("gap_sq", F.col(gap) * F.col(gap))
            .withColumn("fraction", F.try_divide(F.col(part), F.col(whole))))


def found_so_far(df: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """Model number in loss order and whether the flag has come up by then."""
    out = running(df, by, order, sums={"_seen": F.col(flag).cast("long")}, position="model_number")
    return out.withColumn("found_by_now", (F.col("_seen") > 0).cast("int")).drop("_seen")


def epsilon_percent(df: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    """Distance to the best loss of the group in percent (A7); null where that loss is 0."""
    return attach(df, by, _lo=F.min(loss)).withColumn("eps", F.try_divide(F.col(loss) - F.col("_lo"), F.col("_lo")) * 100).drop("_lo")


def cut_by_equal_width(df: DataFrame, column: str, bins: int, out: str, digits: int = 9) -> DataFrame:
    """Upper edge of the equal-width, right-closed interval that holds the value.

    The smallest value forms its own interval; edges are rounded alike on both
    sides of the comparison.
    """
    df = attach(df, _lo=F.min(column), _hi=F.max(column))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)),
                        lambda k: F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / F.lit(bins), digits))
    above = F.filter(edges, lambda e: F.round(F.col(column), digits) <= e)
    return df.withColumn(out, above[0]).drop("_lo", "_hi")


def densify(df: DataFrame, group: list[str], axis: str, values: list, column: str) -> DataFrame:
    """Every (group, axis value) row, missing ones as 0.

    The axis is a configuration list, so each group writes its rows down and
    one equi-join brings the values.
    """
    grid = df.select(*group).distinct().withColumn(axis, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df.select(*group, axis, column), [*group, axis], "left").fillna(0, [column])


def cumulative_presence(df: DataFrame, group: list[str], axis: str, column: str) -> DataFrame:
    """Running maximum along the axis (A10); a group has one row per axis value."""
    w = Window.partitionBy(*group).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("present", F.max(column).over(w))


def rate_per_level(df: DataFrame, by: list[str], column: str = "present") -> DataFrame:
    """Mean presence over replicates (A10)."""
    return df.groupBy(*by).agg(F.avg(column).alias("rate"))


def pad_series(df: DataFrame, group: list[str], position: str, column: str, length_by: list[str] = ()) -> DataFrame:
    """Repeat each group's last state up to the longest series.

    The missing positions are written down from the last row, which a partial
    aggregate finds.
    """
    last = df.groupBy(*group).agg(F.max(position).alias("_n"), F.max_by(column, position).alias(column))
    last = attach(last, length_by, _len=F.max("_n"))
    extra = (last.where(F.col("_len") > F.col("_n"))
             .withColumn(position, F.explode(F.sequence(F.col("_n") + 1, F.col("_len"))))
             .select(*group, position, column))
    return df.select(*group, position, column).unionByName(extra)


def extend_axis(df: DataFrame, axis: str, column: str, start: float, stop: float, step: float) -> DataFrame:
    """Further axis values that carry the largest value reached."""
    top = df.agg(F.max(column)).scalar()
    k = int((stop - start) / step + 1e-9) + 1
    ext = df.sparkSession.range(k).select((F.lit(start) + F.col("id") * F.lit(step)).alias(axis)).withColumn(column, top)
    return df.select(axis, column).unionByName(ext.where(F.col(axis) < stop))


def never_reaching(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Groups in which the flag never comes up."""
    return df.groupBy(*by).agg(F.max(F.col(flag).cast("int")).alias("_any")).where(F.col("_any") == 0).drop("_any")


def named_aggregates(df: DataFrame, by: list[str], means: list[str], deviations: list[str] = ()) -> DataFrame:
    """Means and sample deviations per configuration."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in means], *[F.stddev_samp(c).alias(f"std_{c}") for c in deviations])


def union_of_runs(runs: list[DataFrame], sizes: list | None = None, size: str = "n_per_pol") -> DataFrame:
    """Stack runs and keep some sample sizes."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out if sizes is None else out.where(F.col(size).isin(*sizes))
