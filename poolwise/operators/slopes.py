"""Poolings where each pool has its own regression line.

Cells keep central second moments of (x, y).  Moments add over the cells of a
box, so the facts are read once and one small solve per box gives its error;
partitions are then scored exactly as without slopes.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from poolwise.operators.cells import checked_policy
from poolwise.operators.models import near_optimal_models
from poolwise.operators.partitions import score_partitions, score_space, sum_over_boxes
from poolwise.operators.search import frontier_set
from poolwise.runtime import bounded, scalar
from poolwise.spec import FactorSpec


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(p) for b in range(a, p)]


def slope_cells(spec: FactorSpec, obs: DataFrame, regressors: list[str], y: str = "y") -> DataFrame:
    """Count, means and central co-moments of every observed cell, in one pass over the facts."""
    x = [F.col(c).cast("double") for c in regressors]
    base = obs.select(checked_policy(spec).alias("policy_id"), *[c.alias(f"x{j}") for j, c in enumerate(x)],
                      F.col(y).cast("double").alias("y")).dropna()
    p = len(regressors)
    n = F.count("*")
    return (base.groupBy("policy_id")
            .agg(n.alias("n"), F.avg("y").alias("mean_y"), F.sum("y").alias("sum_y"),
                 *[F.avg(f"x{j}").alias(f"mean_x{j}") for j in range(p)],
                 *[(F.covar_pop(f"x{a}", f"x{b}") * n).alias(f"cxx{a}_{b}") for a, b in _pairs(p)],
                 *[(F.covar_pop(f"x{j}", "y") * n).alias(f"cxy{j}") for j in range(p)],
                 (F.var_pop("y") * n).alias("cyy"))
            .withColumn("profile_id", spec.profile_of_policy()))


def slope_boxes(spec: FactorSpec, cells: DataFrame, p: int) -> DataFrame:
    """Fit of every box: n, sse, coef (intercept first, original units)."""
    fields = ["mean_y"] + [f"mean_x{j}" for j in range(p)]
    centre = cells.agg(F.array(*[F.sum(F.col("n") * F.col(f)) / F.sum("n") for f in fields])).scalar()
    df = cells.withColumn("_c", centre)
    d = [F.col(f) - F.col("_c")[k] for k, f in enumerate(fields)]
    n = F.col("n")
    sums = {"n": n, "s0": n * d[0], "s00": F.col("cyy") + n * d[0] * d[0]}
    for j in range(p):
        sums[f"s{j + 1}"] = n * d[j + 1]
        sums[f"s0_{j + 1}"] = F.col(f"cxy{j}") + n * d[0] * d[j + 1]
    for a, b in _pairs(p):
        sums[f"s{a + 1}_{b + 1}"] = F.col(f"cxx{a}_{b}") + n * d[a + 1] * d[b + 1]
    moments = df.select("policy_id", *[c.cast("double").alias(k) for k, c in sums.items()])
    boxes = sum_over_boxes(spec, moments, list(sums)).withColumn("_c", centre)
    fit = _fit_udf(p)
    solved = boxes.withColumn("_f", fit(F.array(*[F.col(k) for k in _order(p)]), F.col("_c")))
    return solved.select("box_id", F.col("n").cast("long").alias("n"), F.col("_f.sse").alias("sse"), F.col("_f.coef").alias("coef"))


def _order(p: int) -> list[str]:
    return (["n", "s0", "s00"] + [f"s{j + 1}" for j in range(p)] + [f"s0_{j + 1}" for j in range(p)]
            + [f"s{a + 1}_{b + 1}" for a, b in _pairs(p)])


def _fit_udf(p: int):
    """Vectorised p x p solves; a rank-deficient box gets the minimum-norm fit."""
    pairs = _pairs(p)

    @F.pandas_udf("sse double, coef array<double>")
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for moments, centre in batches:
            if len(moments) == 0:
                yield pd.DataFrame({"sse": [], "coef": []})
                continue
            m, c = np.stack(moments.to_numpy()), np.stack(centre.to_numpy())
            n, sy, syy = m[:, 0], m[:, 1], m[:, 2]
            sx, sxy = m[:, 3:3 + p], m[:, 3 + p:3 + 2 * p]
            sxx = np.empty((len(m), p, p))
            for k, (a, b) in enumerate(pairs):
                sxx[:, a, b] = sxx[:, b, a] = m[:, 3 + 2 * p + k]
            gram = sxx - sx[:, :, None] * sx[:, None, :] / n[:, None, None]
            cross = sxy - sx * (sy / n)[:, None]
            # columns on one scale, so the rank cut-off means the same for each
            scale = np.sqrt(np.maximum(np.einsum("ijj->ij", gram), 0.0))
            ref = np.sqrt(np.maximum(np.einsum("ijj->ij", sxx), 0.0))
            alive = scale > 1e-7 * np.maximum(ref, 1e-300)
            live = gram * alive[:, :, None] * alive[:, None, :]
            beta = np.einsum("ijk,ik->ij", np.linalg.pinv(live, rcond=1e-10, hermitian=True), cross * alive)
            sse = np.maximum(syy - sy * sy / n - np.einsum("ij,ij->i", cross, beta), 0.0)
            intercept = c[:, 0] + sy / n - np.einsum("ij,ij->i", c[:, 1:] + sx / n[:, None], beta)
            coef = np.concatenate([intercept[:, None], beta], axis=1)
            yield pd.DataFrame({"sse": sse, "coef": list(coef)})

    return fit


def simple_regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Intercept, slope and error of one regressor per group, from built-in aggregates (L1)."""
    sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    return df.groupBy(*by).agg(F.count("*").alias("n"),
                               F.when(sxx > 0, F.regr_slope(y, x)).otherwise(0.0).alias("slope"),
                               F.when(sxx > 0, F.regr_intercept(y, x)).otherwise(F.avg(y)).alias("intercept"),
                               F.when(sxx > 0, syy - sxy * sxy / sxx).otherwise(syy).alias("sse"))


def slope_scores(spec: FactorSpec, partitions: DataFrame, cells: DataFrame, boxes: DataFrame, reg: float) -> DataFrame:
    """q = sse / N + reg * pools with a line per pool (L2)."""
    return score_partitions(spec, partitions, cells, reg, boxes=boxes)


def slope_lower_bounds(spec: FactorSpec, boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Error of one line per cell, per profile, over all rows (L4)."""
    total = cells.agg(F.sum("n")).scalar()
    return (split_errors(spec, boxes, cells).withColumn("_total", total)
            .select("profile_id", (F.col("sse") / F.col("_total")).alias("lower_bound")))


def split_errors(spec: FactorSpec, boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Squared error of each observed profile with every cut made: one line per cell."""
    singles = cells.selectExpr("profile_id", f"{spec.containing_box_sql(spec.levels_sql(), spec.full_mask_sql())} as box_id")
    return (singles.join(bounded(boxes.select("box_id", "sse"), spec.n_boxes), "box_id")
            .groupBy("profile_id").agg(F.sum("sse").alias("sse")))


def slope_sets(spec: FactorSpec, cells: DataFrame, boxes: DataFrame, theta: float, reg: float,
               profile_id: int | None = None, max_pools: int | None = None, adaptive: bool = False) -> DataFrame:
    """Near-optimal poolings with lines, one profile or all observed ones.

    Over all profiles, each may use what the others leave at best of theta and of the pool budget.  ``adaptive`` searches
    by bounds and does not score the whole space: a line per finer pool never has a larger error.
    """
    if profile_id is not None:
        if adaptive:
            return frontier_set(spec, cells, theta, reg, profile_id, max_pools, boxes=boxes, split=split_errors(spec, boxes, cells))
        return score_space(spec, cells, reg, profile_id, max_pools, boxes).where(F.col("q") <= theta)
    bounds = slope_lower_bounds(spec, boxes, cells)
    every = bounds.agg(F.sum("lower_bound")).scalar()
    limits = bounds.withColumn("theta", F.lit(theta) - (every - F.col("lower_bound"))).select("profile_id", "theta")
    budget = None if max_pools is None else max_pools - scalar(cells.agg(F.count_distinct("profile_id"))) + 1
    if adaptive:
        return frontier_set(spec, cells, theta, reg, max_pools=budget, theta_by_profile=limits, boxes=boxes, split=split_errors(spec, boxes, cells))
    scored = score_space(spec, cells, reg, max_pools=budget, boxes=boxes)
    return scored.join(bounded(limits, spec.n_profiles), "profile_id").where(F.col("q") <= F.col("theta")).drop("theta")


def slope_models(spec: FactorSpec, cells: DataFrame, boxes: DataFrame, theta: float, reg: float,
                 max_pools: int | None = None, adaptive: bool = False) -> DataFrame:
    """Near-optimal models over all profiles with a line per pool."""
    sets = slope_sets(spec, cells, boxes, theta, reg, max_pools=max_pools, adaptive=adaptive)
    return near_optimal_models(spec, cells, theta, reg, max_pools, sets=sets)


def predict_on_grid(spec: FactorSpec, partitions: DataFrame, boxes: DataFrame, grid: DataFrame, regressors: list[str]) -> DataFrame:
    """Fitted value at each requested cell under each partition.

    ``grid`` has the factor levels and the regressor values.
    """
    pools = spec.box_policies(spec.mask_boxes(partitions.select("profile_id", "cut_mask")))
    lines = pools.join(bounded(boxes.select("box_id", "coef"), spec.n_boxes), "box_id")
    points = grid.withColumn("policy_id", spec.policy_id())
    value = F.col("coef")[0]
    for j, x in enumerate(regressors):
        value = value + F.col("coef")[j + 1] * F.col(x)
    return points.join(lines.select("policy_id", "cut_mask", "coef"), "policy_id").withColumn("fitted", value).drop("coef")
