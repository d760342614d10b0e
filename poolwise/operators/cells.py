"""Cell moments: the only pass over the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.runtime import materialize
from poolwise.spec import FactorSpec


def checked_policy(spec: FactorSpec) -> Column:
    """The cell of a row: null where a level is null, an error where one is outside the design."""
    known, inside = F.lit(True), F.lit(True)
    for name, levels in zip(spec.names, spec.levels, strict=True):
        known = known & F.col(name).isNotNull()
        inside = inside & F.col(name).between(0, levels - 1)
    told = F.concat_ws(", ", *(F.concat(F.lit(f"{name} = "), F.col(name).cast("string")) for name in spec.names))
    outside = F.raise_error(F.concat(F.lit("level outside the design: "), told)).cast("long")
    return F.when(known, F.when(inside, spec.policy_id()).otherwise(outside))


def cell_moments(spec: FactorSpec, obs: DataFrame, y: str = "y", by: list[str] = ()) -> DataFrame:
    """n, sum_y, mean_y and the within-cell sum of squares of every observed cell.

    One partial aggregation in front of one shuffle of at most ``n_policies``
    rows per task, so a cell that holds a third of all facts costs its reducer
    no more than any other cell.  Rows without an outcome or a level count
    nowhere; a level outside the design ends the job.
    """
    by = list(by)
    return (obs.select(*by, checked_policy(spec).alias("policy_id"), F.col(y).cast("double").alias("_y"))
            .where(F.col("_y").isNotNull() & F.col("policy_id").isNotNull())
            .groupBy(*by, "policy_id")
            .agg(F.count("*").alias("n"), F.sum("_y").alias("sum_y"), F.avg("_y").alias("mean_y"),
                 (F.var_pop("_y") * F.count("*")).alias("ssw"))
            .withColumn("profile_id", spec.profile_of_policy()))


def cell_table(spec: FactorSpec, obs: DataFrame, y: str = "y", by: list[str] = ()) -> DataFrame:
    """The same, written to the shared folder: use it when more than one step looks at the cells.

    Centres, totals, bounds and boxes all read cells; with the table on disk
    the facts are scanned exactly once, also when an executor is lost later.
    """
    return materialize(cell_moments(spec, obs, y, by), "cells")


def complete_cells(spec: FactorSpec, cells: DataFrame) -> DataFrame:
    """All cells of the design; those without facts carry zeros and a null mean."""
    every = cells.sparkSession.range(spec.n_policies).withColumnRenamed("id", "policy_id")
    return (every.join(cells.drop("profile_id"), "policy_id", "left")
            .fillna(0, ["n", "sum_y", "ssw"])
            .withColumn("profile_id", spec.profile_of_policy()))


def profile_lower_bounds(cells: DataFrame, by: list[str] = ("profile_id",)) -> DataFrame:
    """Least possible loss share of each profile: within-cell squares over all rows."""
    total = cells.agg(F.sum("n")).scalar()
    return (cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("ssw").alias("_ssw"))
            .withColumn("lower_bound", F.col("_ssw") / total).drop("_ssw"))


def observed_profiles(cells: DataFrame) -> DataFrame:
    """Profiles with data and how many of their cells are filled (C4)."""
    return cells.groupBy("profile_id").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n"))


def empty_cells(spec: FactorSpec, cells: DataFrame) -> DataFrame:
    """Cells of the design without facts (C4)."""
    every = cells.sparkSession.range(spec.n_policies).withColumnRenamed("id", "policy_id")
    return every.join(cells.select("policy_id"), "policy_id", "left_anti")


def best_observed(cells: DataFrame) -> DataFrame:
    """Every cell whose mean ties with the best one."""
    best = cells.agg(F.max("mean_y")).scalar()
    return cells.where(F.col("mean_y") == best)


def stratified_cells(spec: FactorSpec, obs: DataFrame, stratum: str, y: str = "y") -> DataFrame:
    """Cell moments per stratum and, with a null stratum, over all strata.

    The facts are reduced to (stratum, cell) first and only these moments are
    doubled for the total.  They are written before their centre is taken, so the
    facts are read and shuffled once.
    """
    per = cell_table(spec, obs, y, [stratum])
    centre = per.agg(F.sum("sum_y") / F.sum("n")).scalar()
    d = F.col("mean_y") - F.col("_centre")
    both = (per.withColumn("_centre", centre)
            .select(F.explode(F.array(F.col(stratum), F.lit(None))).alias(stratum), "policy_id", "n", "sum_y", "ssw",
                    (F.col("n") * d).alias("_s"), (F.col("n") * d * d).alias("_ss")))
    merged = both.groupBy(stratum, "policy_id").agg(*[F.sum(c).alias(c) for c in ["n", "sum_y", "ssw", "_s", "_ss"]])
    between = F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / F.col("n"), F.lit(0.0))
    return (merged.withColumn("mean_y", F.col("sum_y") / F.col("n"))
            .withColumn("ssw", F.col("ssw") + between).drop("_s", "_ss"))


def fitted_mse(rows: DataFrame, y: str | Column = "y", fitted: str | Column = "fitted") -> DataFrame:
    """Mean squared residual over rows."""
    y = F.col(y) if isinstance(y, str) else y
    fitted = F.col(fitted) if isinstance(fitted, str) else fitted
    return rows.agg(F.avg(F.pow(y - fitted, F.lit(2.0))).alias("mse"))
