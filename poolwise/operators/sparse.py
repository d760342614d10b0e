"""Sparse regression on dominance dummies.

The dummy of cell j is 1 for rows whose cell dominates j: it has the same active factors and at least the same levels.
Cells of different profiles share no dummy, so the regression falls into one problem per profile.  Column sums of the
dummy matrix are tail sums over levels and fitted values are head sums, so neither the matrix nor its Gram matrix is
formed, and nothing of design size reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from poolwise.operators.design import dominated_cells
from poolwise.runtime import bounded, materialize
from poolwise.spec import FactorSpec

# Corner sums unfold this many factors before rows of one cell are added up.
FACTORS_PER_SUM = 4
# Coordinate sweeps between two looks at the first-order conditions.
SWEEPS_PER_CHECK = 50
# Cells of a profile that one task solves; power steps, and proximal steps planned as one job, of the way for larger ones.
TASK_CELLS, POWER_STEPS, STEPS_PER_JOB = 20_000, 6, 8


def lasso(spec: FactorSpec, cells: DataFrame, reg: float, tolerance: float = 1e-10, sweeps: int = 100_000, task_cells: int = TASK_CELLS) -> DataFrame:
    """Coefficient of every dummy (X1), without intercept; 0 where no row has the dummy.

    Minimises (1/2n)|y - Xa|^2 + reg |a|_1, profile by profile.  A profile of at most ``task_cells`` cells, which the level
    counts tell, is solved in one task; larger ones together in rounds of Spark jobs (``proximal_rounds``).  Either way
    no first-order condition is violated by more than ``tolerance`` (times the largest mean, if that is above 1) in the
    end, and the job fails if ``sweeps`` rounds do not get there.
    """
    shares = cells.withColumn("_n", cells.agg(F.sum("n")).scalar()).select(
        "profile_id", "policy_id", "mean_y", (F.col("n") / F.col("_n")).alias("share"))
    size = F.lit(1).cast("double")
    for i, r in enumerate(spec.levels):
        size = size * F.when(F.expr(spec.active_sql(i)), F.lit(float(r - 1))).otherwise(F.lit(1.0))
    found = shares.where(size <= task_cells).groupBy("profile_id").applyInPandas(_descent(spec, reg, tolerance, sweeps), "policy_id long, alpha double")
    if spec.n_policies > task_cells:
        large = materialize(shares.where(size > task_cells), "shares")
        if not large.isEmpty():
            found = found.unionByName(proximal_rounds(spec, large, reg, tolerance, sweeps))
    every = cells.sparkSession.range(spec.n_policies).withColumnRenamed("id", "policy_id")
    return every.join(found, "policy_id", "left").fillna(0.0, ["alpha"])


def _summed(spec: FactorSpec, rows: DataFrame, value: str, keep: list[str], upwards: bool) -> DataFrame:
    """``keep`` of each cell of ``rows`` and ``value`` summed over the cells below it (or above, not ``upwards``), itself included.

    Values unfold along a few factors at a time and are added up in between; the other columns stay at their cell, so
    nothing is joined.  Cells that are not in ``rows`` drop out in the end.
    """
    none = [f"if(_own, {c}, null) as {c}" for c in keep]
    df = rows.withColumn("_own", F.lit(True))
    for i in range(spec.m):
        r, w, level = spec.levels[i], spec.strides[i], spec.level_sql(i)
        steps = f"sequence(0, {r - 1} - {level})" if upwards else f"sequence(0, -({level} - 1), -1)"
        df = (df.selectExpr("*", f"explode(if({level} = 0, array(0), {steps})) as _to")
              .selectExpr(f"policy_id + _to * {w}L as policy_id", f"_own and _to = 0 as _own", value, *keep)
              .selectExpr("policy_id", "_own", value, *none))
        if (i + 1) % FACTORS_PER_SUM == 0 or i + 1 == spec.m:
            df = df.groupBy("policy_id").agg(F.sum(value).alias(value), F.max("_own").alias("_own"), *[F.max(c).alias(c) for c in keep])
    return df.where("_own").drop("_own")


def _slope(spec: FactorSpec, state: DataFrame, at: str, keep: list[str], target: bool = True) -> DataFrame:
    """``keep`` and, as ``_g``, the gradient's share of each dummy: X'W(Xa - y), or X'WXa without ``target``."""
    fitted = _summed(spec, state.withColumn("_v", F.col(at)), "_v", ["share", "mean_y", *keep], True)
    off = F.col("_v") - F.col("mean_y") if target else F.col("_v")
    return _summed(spec, fitted.withColumn("_fit", F.col("_v")).withColumn("_g", F.col("share") * off), "_g", ["share", "mean_y", "_fit", *keep], False)


def proximal_rounds(spec: FactorSpec, shares: DataFrame, reg: float, tolerance: float = 1e-10, rounds: int = 100_000) -> DataFrame:
    """The same coefficients by proximal gradient steps with momentum, for profiles of any size.

    ``shares``: policy_id, share of all rows, mean_y.  Fitted values are head sums and gradients tail sums along the factors,
    so a round is two unfoldings with map-side sums; no group is larger than one cell.  Only scalars reach the driver:
    the bound of the curvature (the largest quotient of a power step, which is never too small), the objective, which
    restarts the momentum when it rises, and the largest violation.
    """
    below = shares.select("policy_id")
    for i in range(spec.m):
        level = spec.level_sql(i)
        below = below.selectExpr(f"explode(if({level} = 0, array(policy_id), sequence(policy_id, policy_id - ({level} - 1) * {spec.strides[i]}L, -{spec.strides[i]}L))) as policy_id").distinct()
    state = below.join(shares.select("policy_id", "share", "mean_y"), "policy_id", "left").fillna(0.0, ["share", "mean_y"])
    state = materialize(state.selectExpr("policy_id", "share", "mean_y", "1.0D as alpha", "0.0D as ahead"), "lasso")
    top = state.agg(F.max(F.abs("mean_y"))).first()[0]
    for _ in range(POWER_STEPS):
        power = materialize(_slope(spec, state, "alpha", ["alpha", "ahead"], target=False), "power")
        curve, size = power.agg(F.max(F.try_divide(F.col("_g"), F.col("alpha"))), F.max("_g")).first()
        state = power.selectExpr("policy_id", "share", "mean_y", f"greatest(_g / {size!r}D, 1e-9D) as alpha", "ahead")
    state = state.withColumn("alpha", F.lit(0.0))
    step, before, t, done = 1 / curve, None, 1.0, 0
    while True:
        for _ in range(STEPS_PER_JOB):
            t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            fresh = _soft_threshold(F.col("ahead") - F.col("_g") * step, F.lit(reg * step))
            state = _slope(spec, state, "ahead", ["alpha", "ahead"]).withColumn("_a", fresh)
            state = state.selectExpr("policy_id", "share", "mean_y", "_a as alpha", f"_a + {(old - 1) / t!r}D * (_a - alpha) as ahead")
        seen = materialize(_slope(spec, materialize(state, "lasso"), "alpha", ["alpha", "ahead"]), "lasso")
        off = F.col("mean_y") - F.col("_fit")
        gap = F.when(F.col("alpha") != 0, F.abs(F.col("_g") + reg * F.signum("alpha"))).otherwise(F.greatest(F.abs("_g") - reg, F.lit(0.0)))
        gap, loss = seen.agg(F.max(gap), F.sum(F.col("share") * off * off / 2 + reg * F.abs("alpha"))).first()
        done += STEPS_PER_JOB
        if gap <= tolerance * max(1.0, top):
            return seen.select("policy_id", "alpha")
        if done >= rounds:
            raise RuntimeError(f"the lasso still violates its conditions by {gap} after {rounds} rounds")
        state = seen.select("policy_id", "share", "mean_y", "alpha", "ahead")
        if before is not None and loss > before:
            state, t = state.withColumn("ahead", F.col("alpha")), 1.0
        before = loss


def _descent(spec: FactorSpec, reg: float, tolerance: float, sweeps: int):
    """Solver of one profile: coordinate descent over the dummies that matter, on arrays with one axis per factor."""
    m, levels, strides = spec.m, spec.levels, spec.strides

    def running_sum(x, tail):
        for axis in range(x.ndim):
            x = np.flip(np.cumsum(np.flip(x, axis), axis), axis) if tail else np.cumsum(x, axis)
        return x

    def minimise(weight, mean):
        alpha, curve = np.zeros(weight.shape), running_sum(weight, True)
        limit, left = tolerance * max(1.0, np.abs(mean).max()), sweeps
        while True:
            resid = weight * (mean - running_sum(alpha, False))
            slope = running_sum(resid, True)
            gap = np.where(alpha != 0, np.abs(slope - reg * np.sign(alpha)), np.maximum(np.abs(slope) - reg, 0.0))
            if gap.max() <= limit:
                return alpha
            if left <= 0:
                raise RuntimeError(f"the lasso still violates its conditions by {gap.max()} after {sweeps} sweeps")
            work = [(tuple(j), tuple(slice(k, None) for k in j)) for j in np.argwhere((alpha != 0) | (gap > 0))]
            for _ in range(SWEEPS_PER_CHECK):
                left, moved = left - 1, 0.0
                for j, above in work:
                    z = resid[above].sum() + curve[j] * alpha[j]
                    step = np.sign(z) * max(abs(z) - reg, 0.0) / curve[j] - alpha[j]
                    if step:
                        resid[above] -= weight[above] * step
                        alpha[j] += step
                        moved = max(moved, abs(step))
                if moved <= limit / 10:
                    break

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        profile = int(cells["profile_id"].iloc[0])
        active = [bool(profile >> (m - 1 - i) & 1) for i in range(m)]
        shape = [r - 1 if a else 1 for r, a in zip(levels, active)]
        ids = cells["policy_id"].to_numpy()
        place = tuple((ids // s) % r - 1 if a else np.zeros(len(ids), int) for r, s, a in zip(levels, strides, active))
        weight, mean = np.zeros(shape), np.zeros(shape)
        weight[place], mean[place] = cells["share"], cells["mean_y"]
        alpha = minimise(weight, mean)
        grid = np.indices(shape)
        names = sum((g + a) * s for g, a, s in zip(grid, active, strides))
        return pd.DataFrame({"policy_id": names.ravel().astype("int64"), "alpha": alpha.ravel()})

    return solve


def corner_sums(spec: FactorSpec, cells: DataFrame) -> DataFrame:
    """Coefficients of the saturated fit: the signed sum of the cell means at the corners below each observed cell.

    The dummies of the observed cells fit every cell mean exactly if each cell below an observed one is observed too,
    which is checked.  A mean goes with a plus to its own cell and with a minus to the next level of each active factor.
    """
    below = [f"if({lev} > 1, policy_id - {w}L, null)" for lev, w in zip(spec.levels_sql(), spec.strides)]
    holes = (cells.selectExpr(f"explode(filter(array({', '.join(below)}), p -> p is not null)) as policy_id")
             .join(cells.select("policy_id"), "policy_id", "left_anti"))
    if not holes.isEmpty():
        raise ValueError("the design has no full column rank: some cell below an observed one is empty")
    df = cells.select("policy_id", F.col("mean_y").alias("z"))
    for first in range(0, spec.m, FACTORS_PER_SUM):
        for i in range(first, min(first + FACTORS_PER_SUM, spec.m)):
            ups = f"if({spec.level_sql(i)} between 1 and {spec.levels[i] - 2}, array(0L, 1L), array(0L))"
            df = (df.selectExpr("policy_id", "z", f"explode({ups}) as _up")
                  .selectExpr(f"policy_id + _up * {spec.strides[i]}L as policy_id", "z * (1 - 2 * _up) as z"))
        df = df.groupBy("policy_id").agg(F.sum("z").alias("z"))
    return df.join(cells.select("policy_id"), "policy_id", "left_semi")


def puffer_lasso(spec: FactorSpec, cells: DataFrame, reg: float) -> DataFrame:
    """Lasso after puffer preconditioning (X2): with X = U S V', X~ = U V' and y~ = U S^-1 U' y.

    X has full column rank on the observed cells, so X~'X~ = I and X~'y~ = V S^-1 U' y is the least-squares fit, i.e. the
    corner sums of the cell means; the solution is their soft threshold.
    """
    return (corner_sums(spec, cells).withColumn("_n", cells.agg(F.sum("n")).scalar())
            .select("policy_id", _soft_threshold(F.col("z"), F.lit(float(reg)) * F.col("_n")).alias("alpha")))


def _soft_threshold(z: Column, by: Column) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - by, F.lit(0.0))


def puffer_objective(spec: FactorSpec, cells: DataFrame, alpha: DataFrame, reg: float) -> DataFrame:
    """Error in the preconditioned space plus penalty.

    V is square and y~'y~ = |S^-1 U' y|^2 = z'z for the least-squares fit z, so |y~ - X~ a|^2 = |z - a|^2.
    """
    off = F.col("z") - F.coalesce("alpha", F.lit(0.0))
    return (corner_sums(spec, cells).join(alpha, "policy_id", "left")
            .agg(F.sum(off * off).alias("_sse"), F.sum(F.abs("alpha")).alias("l1"))
            .withColumn("_n", cells.agg(F.sum("n")).scalar())
            .select((F.col("_sse") / F.col("_n")).alias("mse_puffer"), "l1")
            .withColumn("loss", F.col("mse_puffer") + reg * F.col("l1")))


def fitted_cells(spec: FactorSpec, cells: DataFrame, alpha: DataFrame) -> DataFrame:
    """Prediction of each observed cell: the sum of the coefficients it dominates."""
    live = alpha.where(F.col("alpha") != 0).select(F.col("policy_id").alias("dominated_id"), "alpha")
    spread = dominated_cells(spec, cells.select("policy_id"))
    fit = (spread.join(bounded(live, spec.n_policies), "dominated_id", "left").groupBy("policy_id")
           .agg(F.coalesce(F.sum("alpha"), F.lit(0.0)).alias("fitted")))
    return cells.join(fit, "policy_id")


def lasso_scores(fitted: DataFrame, alpha: DataFrame, reg: float) -> DataFrame:
    """Mean squared error and penalised loss, from cell moments."""
    gap = F.col("mean_y") - F.col("fitted")
    return (fitted.agg((F.sum(F.col("ssw") + F.col("n") * gap * gap) / F.sum("n")).alias("mse"))
            .withColumn("l1", alpha.agg(F.sum(F.abs("alpha"))).scalar())
            .withColumn("loss", F.col("mse") + reg * F.col("l1")))


def optimality_gap(spec: FactorSpec, cells: DataFrame, fitted: DataFrame, alpha: DataFrame, reg: float) -> DataFrame:
    """Largest violation of the lasso's first-order conditions, computed from the cells.

    The gradient of dummy j is the residual sum over the cells that dominate j.
    """
    resid = (dominated_cells(spec, fitted.select("policy_id", (F.col("n") * (F.col("mean_y") - F.col("fitted"))).alias("_r")))
             .groupBy(F.col("dominated_id").alias("policy_id")).agg(F.sum("_r").alias("_g")))
    total = cells.agg(F.sum("n")).scalar()
    g = F.col("_g") / F.col("_total")
    gap = F.when(F.col("alpha") != 0, F.abs(g - F.lit(reg) * F.signum("alpha"))).otherwise(F.greatest(F.abs(g) - reg, F.lit(0.0)))
    return resid.withColumn("_total", total).join(alpha, "policy_id").agg(F.max(gap).alias("gap"))
