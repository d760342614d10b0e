"""Queries: pools with slopes, sparse regression, and external partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwise.functions import metrics as X
from poolwise.operators import cells as C, external as E, partitions as P, search as R, slopes as L, sparse as Z
from poolwise.plans import fixtures as fx, sql as S
from poolwise.plans.queries_sets import FULL, KEPT, REG, single_cells
from poolwise.plans.registry import query, rounded
from poolwise.runtime import materialize, scalar

# ---- slopes: one line per pool ------------------------------------------------------------------

SP = fx.SLOPES
REG_L = 1e-4
_LINE = """case when sum(n * x * x + cxx) - sum(n * x) * sum(n * x) / sum(n) > 1e-9 then
        greatest(sum(n * y * y + cyy) - sum(n * y) * sum(n * y) / sum(n) - pow(sum(n * x * y + cxy) - sum(n * x) * sum(n * y) / sum(n), 2)
            / (sum(n * x * x + cxx) - sum(n * x) * sum(n * x) / sum(n)), 0)
    else sum(n * y * y + cyy) - sum(n * y) * sum(n * y) / sum(n) end"""
_SLOPE_CELLS = f"""obs as ({S.OBS['slopes']}), lcells as (select disc, tax, flag, cast({S.policy(SP)} as bigint) policy_id, cast({S.profile(SP)} as int) profile_id,
    count(*) n, avg(x) x, avg(y) y, covar_pop(x, x) * count(*) cxx, covar_pop(x, y) * count(*) cxy, var_pop(y) * count(*) cyy from obs group by disc, tax, flag)"""
_SLOPES = f"""{_SLOPE_CELLS}, {S.masks(SP, 7)},
    lpooled as (select p.cut_mask, p.h, {S.pool(SP, 'c', 'p.cut_mask')} pool_id, cast(sum(n) as bigint) n, {_LINE} sse from parts p join lcells c using (profile_id) group by 1, 2, 3),
    lscored as (select cut_mask, h, sum(sse) sse, sum(sse) / (select sum(n) from lcells) + {REG_L} * h q from lpooled group by 1, 2),
    lbest as (select min(q) * 1.002 theta from lscored)"""


def _slope_tables(spark, sf):
    cells = materialize(L.slope_cells(SP, fx.lineitem_slopes(spark, sf), ["x"]), "cells")
    return cells, materialize(L.slope_boxes(SP, cells, 1), "boxes")


def _slope_scores(spark, sf):
    cells, boxes = _slope_tables(spark, sf)
    return materialize(L.slope_scores(SP, P.enumerate_partitions(spark, SP, 7), cells, boxes, REG_L), "scores"), cells, boxes


@query("slope_cell_lines", f"""with obs as ({S.OBS['slopes']}) select disc, tax, flag, count(*) n, round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 6) intercept,
    round(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 5) sse from obs group by disc, tax, flag""")
def slope_cell_lines(spark, sf):
    df = L.simple_regression(fx.lineitem_slopes(spark, sf), ["disc", "tax", "flag"], "x", "y")
    return df.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 6), "sse": F.round("sse", 5)})


@query("slope_pool_fit", f"""with obs as ({S.OBS['slopes']}) select 1 as lo, 2 as hi, count(*) n, round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 6) intercept,
    round(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 4) sse from obs where disc <= 2
    union all select 3, 4, count(*), round(regr_slope(y, x), 6), round(regr_intercept(y, x), 6), round(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 4) from obs where disc >= 3""")
def slope_pool_fit(spark, sf):
    """The two pools of the partition that cuts ``disc`` in the middle."""
    _, boxes = _slope_tables(spark, sf)
    part = spark.range(1).selectExpr("7 as profile_id", "2L as cut_mask")
    pools = SP.mask_boxes(part).join(boxes, "box_id")
    return pools.select(F.expr(SP.box_low_sql(0)).alias("lo"), F.expr(f"cast({SP.box_code_sql(0)} % {SP.levels[0]} as int)").alias("hi"), "n",
                        F.round(F.col("coef")[1], 6).alias("slope"), F.round(F.col("coef")[0], 6).alias("intercept"), F.round("sse", 4).alias("sse"))


@query("slope_loss", f"with {_SLOPES} select cut_mask, h, round(q, 7) q from lscored")
def slope_loss(spark, sf):
    return _slope_scores(spark, sf)[0].select("cut_mask", "h", F.round("q", 7).alias("q"))


@query("slope_bound", f"""with {_SLOPES}, s as (select cut_mask node, cut_mask | (3::bigint << 3) split, (cut_mask | (1::bigint << 3)) & ~(2::bigint << 3) few from lscored)
    select node cut_mask, f.h h_min, round(a.sse / (select sum(n) from lcells) + {REG_L} * f.h, 7) bound from s join lscored a on a.cut_mask = split join lscored f on f.cut_mask = few""")
def slope_bound(spark, sf):
    cells, boxes = _slope_tables(spark, sf)
    df = P.lower_bound(SP, P.enumerate_partitions(spark, SP, 7), cells, 1, 0, REG_L, boxes=boxes)
    return df.select("cut_mask", "h_min", F.round("bound", 7).alias("bound"))


@query("slope_lower_bound", f"""with {_SLOPE_CELLS} select profile_id, round(sum(case when cxx > 0 then cyy - cxy * cxy / cxx else cyy end) / sum(n), 7) lower_bound from lcells group by 1""")
def slope_lower_bound(spark, sf):
    cells, boxes = _slope_tables(spark, sf)
    return rounded(L.slope_lower_bounds(SP, boxes, cells), 7)


@query("slope_profile_set", f"with {_SLOPES} select cut_mask, h, round(q, 7) q from lscored, lbest where q <= theta")
def slope_profile_set(spark, sf):
    scored, cells, boxes = _slope_scores(spark, sf)
    theta = scored.agg(F.min("q")).first()[0] * 1.002
    return L.slope_sets(SP, cells, boxes, theta, REG_L, 7).select("cut_mask", "h", F.round("q", 7).alias("q"))


_LEVEL_MULTI = f"""{S.cells(fx.MULTI, 'multi')}, {S.masks(fx.MULTI)}, big as (select p.profile_id, p.cut_mask, p.h, {S.pool(fx.MULTI, 'c', 'p.cut_mask')} pool_id, c.n, c.qty * 1.0 x, c.mean_y y, c.ssw cyy, 0.0 cxx, 0.0 cxy
        from parts p join cells c using (profile_id)),
    lpooled as (select profile_id, cut_mask, h, pool_id, {_LINE} sse from big group by 1, 2, 3, 4),
    lscored as (select profile_id, cut_mask, h, sum(sse) / (select sum(n) from cells) + 0.001 * h q from lpooled group by 1, 2, 3),
    lb as (select profile_id, sum(ssw) / (select sum(n) from cells) lb from cells group by 1)"""


THETA_J = 0.015


def _joined(sets: str, profiles, theta: float) -> str:
    """All choices of one partition per profile, by plain joins."""
    first, *rest = profiles
    return (f"select {' || \'|\' || '.join(f'\'{p}:\' || s{p}.cut_mask' for p in profiles)} model_key, {' + '.join(f's{p}.q' for p in profiles)} loss, "
            f"{' + '.join(f's{p}.h' for p in profiles)} n_pools from (select * from {sets} where profile_id = {first}) s{first}"
            + "".join(f" join (select * from {sets} where profile_id = {p}) s{p} on {' + '.join(f's{o}.q' for o in profiles if o <= p)} <= {theta}" for p in rest))


@query("slope_sets", f"""with {_LEVEL_MULTI} select s.profile_id, s.cut_mask, s.h, round(q, 7) q from lscored s join lb using (profile_id) where q <= 0.0121 - (select sum(lb) from lb) + lb""")
def slope_sets(spark, sf):
    """All profiles; the regressor is the quantity level, constant inside a cell and in narrow pools."""
    obs = fx.lineitem_multi(spark, sf).withColumn("x", F.col("qty").cast("double"))
    cells = materialize(L.slope_cells(fx.MULTI, obs, ["x"]), "cells")
    boxes = materialize(L.slope_boxes(fx.MULTI, cells, 1), "boxes")
    return L.slope_sets(fx.MULTI, cells, boxes, 0.0121, 0.001).select("profile_id", "cut_mask", "h", F.round("q", 7).alias("q"))


@query("slope_models", f"""with {_LEVEL_MULTI}, sets as (select s.profile_id, s.cut_mask, s.h, q from lscored s join lb using (profile_id) where q <= {THETA_J} - (select sum(lb) from lb) + lb),
    models as ({_joined('sets', range(8), THETA_J)})
    select model_key, round(loss, 7) loss, cast(n_pools as bigint) n_pools from models where loss <= {THETA_J} and n_pools <= 11""")
def slope_models(spark, sf):
    """Models over all profiles with a line per pool, within a budget of pools."""
    obs = fx.lineitem_multi(spark, sf).withColumn("x", F.col("qty").cast("double"))
    cells = materialize(L.slope_cells(fx.MULTI, obs, ["x"]), "cells")
    boxes = materialize(L.slope_boxes(fx.MULTI, cells, 1), "boxes")
    found = L.slope_models(fx.MULTI, cells, boxes, THETA_J, 0.001, max_pools=11)
    return found.select("model_key", F.round("loss", 7).alias("loss"), "n_pools")


@query("slope_frontier", f"with {_SLOPES} select cut_mask, h, round(q, 7) q from lscored where q <= (select median(q) from lscored) and h <= 12")
def slope_frontier(spark, sf):
    """Half of the space and a budget of pools, found by bounds."""
    scored, cells, boxes = _slope_scores(spark, sf)
    theta = scored.agg(F.median("q")).first()[0]
    return L.slope_sets(SP, cells, boxes, theta, REG_L, 7, max_pools=12, adaptive=True).select("cut_mask", "h", F.round("q", 7).alias("q"))


def _two() -> str:
    s = lambda a, b: f"(sum(n * {a} * {b} + c{a}{b}) - sum(n * {a}) * sum(n * {b}) / sum(n))"
    return f"{s('x', 'x')} sxx, {s('d', 'd')} sdd, {s('x', 'd')} sxd, {s('x', 'y')} sxy, {s('d', 'y')} sdy, {s('y', 'y')} syy"


_TWO = f"""{_SLOPE_CELLS}, {S.masks(SP, 7)}, c2 as (select disc, tax, flag, profile_id, n, x, y, disc * 1.0 d, cxx, cxy, cyy, 0.0 cdd, 0.0 cxd, 0.0 cdy from lcells),
    p2 as (select p.cut_mask, p.h, {S.pool(SP, 'c', 'p.cut_mask')} pool_id, {_two()} from parts p join c2 c using (profile_id) group by 1, 2, 3),
    e2 as (select cut_mask, h, case when sdd < 1e-6 then syy - sxy * sxy / sxx else syy - ((sdd * sxy - sxd * sdy) * sxy + (sxx * sdy - sxd * sxy) * sdy) / (sxx * sdd - sxd * sxd) end sse from p2)"""


@query("slope_two_regressors", f"with {_TWO} select cut_mask, h, round(sum(sse) / (select sum(n) from lcells) + {REG_L} * h, 7) q from e2 group by 1, 2")
def slope_two_regressors(spark, sf):
    """Two regressors, one of them constant in many pools: minimum-norm fits."""
    obs = fx.lineitem_slopes(spark, sf).withColumn("d", F.col("disc").cast("double"))
    cells = materialize(L.slope_cells(SP, obs, ["x", "d"]), "cells")
    boxes = materialize(L.slope_boxes(SP, cells, 2), "boxes")
    return L.slope_scores(SP, P.enumerate_partitions(spark, SP, 7), cells, boxes, REG_L).select("cut_mask", "h", F.round("q", 7).alias("q"))


@query("slope_predict", f"""with {_SLOPES}, keptl as (select cut_mask from lscored, lbest where q <= theta),
    fits as (select p.cut_mask, {S.pool(SP, 'c', 'p.cut_mask')} pool_id, (sum(n * x * y + cxy) - sum(n * x) * sum(n * y) / sum(n)) / (sum(n * x * x + cxx) - sum(n * x) * sum(n * x) / sum(n)) b,
        sum(n * y) / sum(n) my, sum(n * x) / sum(n) mx from keptl p, lcells c group by 1, 2)
    select k.cut_mask, c.policy_id, round(f.my + f.b * (c.x - f.mx), 6) fitted from keptl k, lcells c join fits f on f.cut_mask = k.cut_mask and f.pool_id = {S.pool(SP, 'c', 'k.cut_mask')}""")
def slope_predict(spark, sf):
    """The lines of the set at each cell's mean regressor."""
    scored, cells, boxes = _slope_scores(spark, sf)
    theta = scored.agg(F.min("q")).first()[0] * 1.002
    grid = cells.select(*SP.level_columns(), F.col("mean_x0").alias("x"))
    df = L.predict_on_grid(SP, scored.where(F.col("q") <= theta), boxes, grid, ["x"])
    return df.select("cut_mask", "policy_id", F.round("fitted", 6).alias("fitted"))


# ---- sparse regression -----------------------------------------------------------------------------


def _lasso_sql(reg: float, sweeps: int) -> str:
    """CTEs cells, solved(profile_id, ids, alpha): coordinate descent over all dummies of a profile, a sweep per step."""
    spec, names = fx.MULTI, fx.MULTI.names
    above = lambda c, j: " and ".join(f"{c}.{n} >= {j}.{n}" for n in names)
    both = " and ".join(f"c.{n} >= greatest(j.{n}, k.{n})" for n in names)
    z = "(right_side[j[1]::int] - list_dot_product(gram[j[1]::int], s) + gram[j[1]::int][j[1]::int] * s[j[1]::int])"
    fresh = f"sign({z}) * greatest(abs({z}) - {reg}, 0) / gram[j[1]::int][j[1]::int]"
    return f"""{S.cells(spec, 'multi')}, weighed as (select *, n / sum(n) over () as share from cells),
    dummies as (select distinct j.* from (select policy_id, {S.decode(spec)} from (select unnest(range({spec.n_policies})) policy_id)) j join cells c on {above('c', 'j')} and {S.profile(spec, ['j.' + n for n in names])} = c.profile_id),
    sided as (select j.*, c.profile_id, sum(c.share * c.mean_y) side from dummies j join weighed c on {above('c', 'j')} and {S.profile(spec, ['j.' + n for n in names])} = c.profile_id group by all),
    pairs as (select j.profile_id, j.policy_id j, k.policy_id k, coalesce((select sum(c.share) from weighed c where c.profile_id = j.profile_id and {both}), 0) g from sided j join sided k using (profile_id)),
    per_row as (select profile_id, j, list(g order by k) row from pairs group by all),
    systems as (select per_row.profile_id, list(j order by j) ids, list(row order by j) gram, list(side order by j) right_side from per_row join sided on j = policy_id group by 1),
    sweep as (select profile_id, 0 turn, list_transform(ids, lambda x: 0.0::double) alpha from systems union all
        select profile_id, turn + 1, list_reduce(list_concat([alpha], list_transform(range(1, len(ids) + 1), lambda j: [j::double])),
            lambda s, j: list_transform(s, lambda x, i: case when i = j[1]::int then {fresh} else x end)) from sweep join systems using (profile_id) where turn < {sweeps}),
    solved as (select profile_id, unnest(ids) policy_id, unnest(alpha) alpha from sweep join systems using (profile_id) where turn = {sweeps})"""


@query("lasso_coefficients", f"""with recursive {_lasso_sql(1e-3, 1000)}
    select policy_id, round(coalesce(alpha, 0), 6) + 0.0 alpha from (select unnest(range({fx.MULTI.n_policies})) policy_id) left join solved using (policy_id)""")
def lasso_coefficients(spark, sf):
    return Z.lasso(fx.MULTI, multi(spark, sf), 1e-3).select("policy_id", (F.round("alpha", 6) + 0.0).alias("alpha"))


def multi(spark, sf):
    return C.cell_table(fx.MULTI, fx.lineitem_multi(spark, sf))


@query("lasso_conditions", f"""with recursive {_lasso_sql(1e-3, 1000)},
    slopes as (select sided.profile_id, sided.policy_id, solved.alpha, side - list_dot_product(gram[list_position(ids, sided.policy_id)], sweep.alpha) slope from sided join systems using (profile_id)
        join sweep using (profile_id) join solved on solved.policy_id = sided.policy_id where turn = 1000)
    select (select count(*) from cells) n_dummies, max(case when alpha = 0 then greatest(abs(slope) - 1e-3, 0) else abs(slope - 1e-3 * sign(alpha)) end) < 1e-8 is_optimal,
        count(*) filter (alpha <> 0) n_active, round(sum(abs(alpha)), 6) l1 from slopes""")
def lasso_conditions(spark, sf):
    """The first-order conditions of the lasso, recomputed from the cells."""
    cells = multi(spark, sf)
    alpha = Z.lasso(fx.MULTI, cells, 1e-3)
    gap = Z.optimality_gap(fx.MULTI, cells, Z.fitted_cells(fx.MULTI, cells, alpha), alpha, 1e-3)
    return cells.agg(F.count("*").alias("n_dummies")).withColumn("is_optimal", gap.select(F.col("gap") < 1e-8).scalar()).withColumn(
        "n_active", alpha.agg(F.count_if(F.col("alpha") != 0)).scalar()).withColumn("l1", alpha.agg(F.round(F.sum(F.abs("alpha")), 6)).scalar())


def _moebius() -> str:
    """Cell means to dominance coefficients: signed sum over the corners below each cell."""
    dims = list(zip(fx.SINGLE.names, fx.SINGLE.levels))
    shifts = [(a, b, c, d) for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)]
    arms = " union all ".join(
        f"select {', '.join(f'{n} + {e} {n}' for (n, _), e in zip(dims, s))}, {-1 if sum(s) % 2 else 1} * mean_y v from cells where "
        + " and ".join(f"{n} + {e} < {r}" for (n, r), e in zip(dims, s)) for s in shifts)
    return f"ols as (select cast({S.policy(fx.SINGLE)} as bigint) policy_id, sum(v) z from ({arms}) group by {', '.join(fx.SINGLE.names)})"


@query("lasso_puffer", f"""with {S.cells(fx.SINGLE, 'single')}, {_moebius()}
    select policy_id, round(sign(z) * greatest(abs(z) - 2e-7 * (select sum(n) from cells), 0), 7) + 0.0 alpha from ols""")
def lasso_puffer(spark, sf):
    """Preconditioned, the lasso is a soft threshold of the saturated least-squares fit."""
    alpha = Z.puffer_lasso(fx.SINGLE, single_cells(spark, sf), 2e-7)
    return alpha.select("policy_id", (F.round("alpha", 7) + 0.0).alias("alpha"))


@query("lasso_puffer_scores", f"""with {S.cells(fx.SINGLE, 'single')}, {_moebius()}, al as (select policy_id, sign(z) * greatest(abs(z) - 2e-7 * (select sum(n) from cells), 0) alpha from ols),
    fit as (select a.policy_id, sum(al.alpha) f from cells a join cells b on a.qty >= b.qty and a.disc >= b.disc and a.tax >= b.tax and a.flag >= b.flag join al on al.policy_id = b.policy_id group by 1)
    select round(sum(ssw + n * (mean_y - f) * (mean_y - f)) / sum(n), 8) mse, round((select sum(abs(alpha)) from al), 7) l1,
        round(sum(ssw + n * (mean_y - f) * (mean_y - f)) / sum(n) + 2e-7 * (select sum(abs(alpha)) from al), 8) loss from cells join fit using (policy_id)""")
def lasso_puffer_scores(spark, sf):
    cells = single_cells(spark, sf)
    alpha = materialize(Z.puffer_lasso(fx.SINGLE, cells, 2e-7), "alpha")
    df = Z.lasso_scores(Z.fitted_cells(fx.SINGLE, cells, alpha), alpha, 2e-7)
    return df.select(F.round("mse", 8).alias("mse"), F.round("l1", 7).alias("l1"), F.round("loss", 8).alias("loss"))


@query("lasso_puffer_objective", f"""with {S.cells(fx.SINGLE, 'single')}, {_moebius()}, al as (select z, sign(z) * greatest(abs(z) - 2e-7 * (select sum(n) from cells), 0) alpha from ols)
    select round(sum((z - alpha) * (z - alpha)) / (select sum(n) from cells), 9) mse_puffer, round(sum(abs(alpha)), 7) l1,
        round(sum((z - alpha) * (z - alpha)) / (select sum(n) from cells) + 2e-7 * sum(abs(alpha)), 9) loss from al""")
def lasso_puffer_objective(spark, sf):
    cells = single_cells(spark, sf)
    df = Z.puffer_objective(fx.SINGLE, cells, Z.puffer_lasso(fx.SINGLE, cells, 2e-7), 2e-7)
    return df.select(F.round("mse_puffer", 9).alias("mse_puffer"), F.round("l1", 7).alias("l1"), F.round("loss", 9).alias("loss"))


@query("lasso_scores", f"""with recursive {_lasso_sql(1e-3, 1000)},
    fit as (select c.policy_id, sum(s.alpha) f from cells c join dummies d on {" and ".join(f"c.{n} >= d.{n} and (c.{n} > 0) = (d.{n} > 0)" for n in fx.MULTI.names)} join solved s on s.policy_id = d.policy_id group by 1),
    truth as (select policy_id, {" + ".join(fx.MULTI.names)} dosage from cells where round(mean_y, 1) = (select max(round(mean_y, 1)) from cells)),
    mine as (select policy_id from fit where round(f, 1) = (select max(round(f, 1)) from fit)),
    scored as (select sum(ssw + n * (mean_y - f) * (mean_y - f)) / sum(n) mse, (select sum(abs(alpha)) from solved) l1 from cells join fit using (policy_id))
    select round(mse, 6) mse, round(l1, 6) l1, round(mse + 1e-3 * l1, 6) loss,
        round((select count(*) from truth semi join mine using (policy_id)) * 1.0 / (select count(*) from (select policy_id from truth union select policy_id from mine)), 6) iou,
        (select count(*) > 0 from truth semi join mine using (policy_id) where dosage = (select min(dosage) from truth)) min_dosage_hit,
        round((select max(mean_y) from cells) - (select max(f) from fit), 6) gap from scored""")
def lasso_scores(spark, sf):
    """Error, loss, best-cell overlap and least-dosage hit of the lasso fit."""
    cells = multi(spark, sf)
    alpha = materialize(Z.lasso(fx.MULTI, cells, 1e-3), "alpha")
    fitted = materialize(Z.fitted_cells(fx.MULTI, cells, alpha), "fitted")
    truth = X.best_policies(cells, "mean_y", digits=1)
    mine = X.best_policies(fitted, "fitted", digits=1)
    df = Z.lasso_scores(fitted, alpha, 1e-3).withColumn("iou", F.lit(scalar(X.intersection_over_union(truth, mine))))
    low = X.min_dosage(truth.select("policy_id", *fx.MULTI.level_columns()), list(fx.MULTI.names))
    df = df.withColumn("min_dosage_hit", X.shares_member(low, mine).scalar())
    gap = X.best_effect_gap(cells, fitted, "mean_y", "fitted").first()["gap"]
    return rounded(df.withColumn("gap", F.lit(gap)))


# ---- external partitions ----------------------------------------------------------------------------

# pool rules over the observed cells: one box partition, one with a pool that is no box, one of boxes
# whose split does not repeat, and the 22 partitions of the set under other pool numbers
_RULES = {
    1: "(qty + 1) // 2 * 10 + (case when disc <= 2 then 1 else 2 end)",
    2: "case when qty = 1 and disc = 1 then 0 when qty + disc <= 4 then 1 else 2 end",
    3: "case when qty <= 2 then (case when disc <= 2 then 1 else 2 end) else 3 end",
    4: "case when qty = 5 then 2 else 1 end",
}
_EXT = "ext as (" + " union all ".join(f"select {k} partition_id, cast({r} as bigint) pool_id, policy_id, qty, disc, tax, flag from cells" for k, r in _RULES.items()) + ")"
_EXT_BOX = f"""{S.cells(fx.SINGLE, 'single')}, {_EXT}, box as (select partition_id, pool_id, count(*) n_cells,
    cast((max(qty) - min(qty) + 1) * (max(disc) - min(disc) + 1) * (max(tax) - min(tax) + 1) * (max(flag) - min(flag) + 1) as bigint) volume from ext group by 1, 2)"""


def _external(spark, sf):
    cells = single_cells(spark, sf).select("policy_id", *fx.SINGLE.level_columns())
    rules = ", ".join(f"named_struct('partition_id', {k}, 'pool_id', cast({r.replace('//', 'div')} as bigint))" for k, r in _RULES.items())
    return materialize(cells.selectExpr("policy_id", f"inline(array({rules}))"), "external")


@query("ext_box", f"with {_EXT_BOX} select partition_id, pool_id, n_cells, volume, n_cells = volume is_box from box")
def ext_box(spark, sf):
    return E.box_check(fx.SINGLE, _external(spark, sf))


@query("ext_permissible", f"""with {_EXT_BOX}, boxes as (select partition_id, bool_and(n_cells = volume) all_boxes from box group by 1),
    steps as (select a.partition_id, case when a.qty <> b.qty then 'q' || least(a.qty, b.qty) when a.disc <> b.disc then 'd' || least(a.disc, b.disc) when a.tax <> b.tax then 't' || least(a.tax, b.tax)
        else 'f' || least(a.flag, b.flag) end step, min(case when a.pool_id = b.pool_id then 1 else 0 end) = max(case when a.pool_id = b.pool_id then 1 else 0 end) even
        from ext a join ext b on a.partition_id = b.partition_id and abs(a.qty - b.qty) + abs(a.disc - b.disc) + abs(a.tax - b.tax) + abs(a.flag - b.flag) = 1 group by 1, 2)
    select partition_id, all_boxes, all_boxes and (select bool_and(even) from steps s where s.partition_id = b.partition_id) is_permissible from boxes b""")
def ext_permissible(spark, sf):
    return E.permissible(fx.SINGLE, _external(spark, sf))


@query("ext_overlap", f"""with {KEPT}, {_EXT}, keys as (select partition_id, string_agg(k, '|' order by k) pk from (select partition_id, pool_id, string_agg(policy_id, ',' order by policy_id) k from ext group by 1, 2) group by 1),
    mine as (select cut_mask, string_agg(k, '|' order by k) pk from (select cut_mask, pool_id, string_agg(policy_id, ',' order by policy_id) k from assigned group by 1, 2) group by 1)
    select partition_id from keys semi join (select pk from mine where cut_mask in (select cut_mask from scored where q <= 0.02)) using (pk)""")
def ext_overlap(spark, sf):
    sets = R.exhaustive_set(fx.SINGLE, single_cells(spark, sf), 0.02, REG, FULL)
    return E.overlap_with_set(fx.SINGLE, _external(spark, sf), sets)


@query("ext_replicates", """
    with t as (select l_returnflag setting, l_linenumber replicate, count(*) n, avg(l_quantity) mean_qty from lineitem group by 1, 2)
    select setting, count(*) n_replicates, round(avg(n), 6) n, round(avg(mean_qty), 6) mean_qty from t group by 1""")
def ext_replicates(spark, sf):
    from poolwise.sources.tables import read_table
    runs = (read_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("setting"), F.col("l_linenumber").alias("replicate"))
            .agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_qty")))
    return rounded(E.replicate_means(runs, ["setting"], ["n", "mean_qty"]))
