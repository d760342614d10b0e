"""Queries: partitions, their losses, and sets of near-optimal partitions and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwise.functions import posterior as B
from poolwise.operators import cells as C, design as D, models as M, partitions as P, prep, search as R
from poolwise.plans import fixtures as fx, sql as S
from poolwise.plans.registry import query, rounded
from poolwise.runtime import materialize, scratch_path
from poolwise.sources.tables import load_model_set, read_table, save_model_set

FULL = 15
REG, THETA = 1e-4, 0.0055
REG_M, THETA_M = 1e-3, 0.0206
USED_POOLS = 13

SINGLE = S.scores(fx.SINGLE, "single", REG, FULL)
MULTI = S.scores(fx.MULTI, "multi", REG_M)
KEPT = f"{SINGLE}, kept as (select * from scored where q <= {THETA})"
MODELS = S.models(fx.MULTI, "multi", REG_M, THETA_M)


def single_cells(spark, sf):
    return C.cell_table(fx.SINGLE, fx.lineitem_single(spark, sf))


def multi_cells(spark, sf):
    return C.cell_table(fx.MULTI, fx.lineitem_multi(spark, sf))


def kept(spark, sf, cells=None):
    """The near-optimal set that many queries look at, as a written table."""
    cells = cells if cells is not None else single_cells(spark, sf)
    return materialize(R.exhaustive_set(fx.SINGLE, cells, THETA, REG, FULL), "kept")


def multi_models(spark, sf, **options):
    return M.near_optimal_models(fx.MULTI, multi_cells(spark, sf), THETA_M, REG_M, **options)


# ---- partitions ---------------------------------------------------------------------------


@query("part_loss", f"with {SINGLE} select profile_id, cut_mask, h, round(sse, 6) sse, round(q, 9) q from scored")
def part_loss(spark, sf):
    df = P.score_partitions(fx.SINGLE, P.enumerate_partitions(spark, fx.SINGLE, FULL), single_cells(spark, sf), REG)
    return df.withColumns({"sse": F.round("sse", 6), "q": F.round("q", 9)})


@query("part_loss_profiles", f"with {MULTI} select profile_id, cut_mask, h, round(q, 9) q from scored")
def part_loss_profiles(spark, sf):
    df = P.score_partitions(fx.MULTI, P.enumerate_partitions(spark, fx.MULTI), multi_cells(spark, sf), REG_M)
    return df.select("profile_id", "cut_mask", "h", F.round("q", 9).alias("q"))


@query("part_pool_count", f"""with {MULTI}, counted as (select profile_id, cut_mask, count(distinct {S.pool(fx.MULTI, 'c', 'p.cut_mask')}) h
        from parts p join cells c using (profile_id) group by all)
    select profile_id, cut_mask, cast(h as bigint) h, cast((select sum(n) from cells k where k.profile_id = counted.profile_id) as bigint) n from counted""")
def part_pool_count(spark, sf):
    rows = multi_cells(spark, sf).groupBy("profile_id").agg(F.sum("n").alias("n"))
    return P.enumerate_partitions(spark, fx.MULTI).join(F.broadcast(rows), "profile_id").select("profile_id", "cut_mask", "h", "n")


@query("part_by_size", f"""with {MULTI} select profile_id, h, count(*) n_partitions, round(min(q), 9) best_q from scored group by 1, 2""")
def part_by_size(spark, sf):
    scored = materialize(P.score_partitions(fx.MULTI, P.enumerate_partitions(spark, fx.MULTI), multi_cells(spark, sf), REG_M), "scored")
    best = scored.groupBy("profile_id", "h").agg(F.round(F.min("q"), 9).alias("best_q"))
    return P.count_by_size(scored).join(best, ["profile_id", "h"])


@query("part_size_counts", f"""with {MULTI} select profile_id, h, count(*) n_partitions from scored group by 1, 2""")
def part_size_counts(spark, sf):
    """Partitions of every observed profile by their number of pools, by convolution: none is listed."""
    return P.partition_sizes(fx.MULTI, multi_cells(spark, sf))


@query("part_pools", f"""with {KEPT} select k.cut_mask, c.policy_id, {S.pool(fx.SINGLE, 'c', 'k.cut_mask')} pool_id from kept k, cells c""")
def part_pools(spark, sf):
    cells = single_cells(spark, sf)
    observed = cells.select("policy_id")
    return P.assign_pools(fx.SINGLE, kept(spark, sf, cells)).join(observed, "policy_id", "left_semi").select("cut_mask", "policy_id", "pool_id")


@query("part_pool_means", f"""with {KEPT} select cut_mask, n, round(sum_y, 6) sum_y, round(mean_y, 6) mean_y from pooled
    where cut_mask in (select cut_mask from kept)""")
def part_pool_means(spark, sf):
    cells = single_cells(spark, sf)
    boxes = P.box_moments(fx.SINGLE, cells)
    return rounded(P.pool_means(fx.SINGLE, kept(spark, sf, cells), boxes).select("cut_mask", "n", "sum_y", "mean_y"))


@query("part_pool_means_wide", f"""with {KEPT} select cut_mask, n, round(mean_y, 6) mean_y from pooled where cut_mask in (select cut_mask from kept)""")
def part_pool_means_wide(spark, sf):
    """The route for designs with too many boxes to list: only the boxes in use are summed."""
    cells = single_cells(spark, sf)
    sets = kept(spark, sf, cells)
    boxes = P.needed_box_moments(fx.SINGLE, cells, fx.SINGLE.mask_boxes(sets))
    return rounded(P.pool_means(fx.SINGLE, sets, boxes).select("cut_mask", "n", "mean_y"))


@query("part_predict", f"""with {KEPT}, fit as (select a.cut_mask, a.policy_id, p.mean_y fitted, p.pool_id from assigned a
        join pooled p using (cut_mask, pool_id) where a.cut_mask in (select cut_mask from kept))
    select cut_mask, pool_id, count(*) n, round(avg(fitted), 6) fitted, round(avg((y - fitted) * (y - fitted)), 9) mse
    from obs join cells using (qty, disc, tax, flag) join fit using (policy_id) group by all""".replace("round(avg((y", "round(avg((obs.y").replace("- fitted) * (y -", "- fitted) * (obs.y -"))
def part_predict(spark, sf):
    cells = single_cells(spark, sf)
    obs = fx.lineitem_single(spark, sf)
    boxes = P.box_moments(fx.SINGLE, cells)
    rows = P.predict(fx.SINGLE, obs, kept(spark, sf, cells), boxes)
    return (rows.groupBy("cut_mask", "pool_id")
            .agg(F.count("*").alias("n"), F.round(F.avg("fitted"), 6).alias("fitted"),
                 F.round(F.avg(F.pow(F.col("y") - F.col("fitted"), F.lit(2.0))), 9).alias("mse")))


@query("part_maximal_split", f"""with {KEPT}, s as (select cut_mask node, cut_mask | (6::bigint << 4) cut_mask from kept)
    select node cut_mask, s.cut_mask split_mask, h, round(q, 9) q from s join scored using (cut_mask)""")
def part_maximal_split(spark, sf):
    """Factor ``disc`` cut from its second position on."""
    cells = single_cells(spark, sf)
    nodes = kept(spark, sf, cells).select("profile_id", F.col("cut_mask").alias("node"), F.expr(P.maximal_split(fx.SINGLE, 1, 1)).alias("cut_mask"))
    scored = P.score_partitions(fx.SINGLE, nodes.select("profile_id", "cut_mask").distinct(), cells, REG)
    return nodes.join(scored, ["profile_id", "cut_mask"]).select(F.col("node").alias("cut_mask"), F.col("cut_mask").alias("split_mask"), "h", F.round("q", 9).alias("q"))


@query("part_bound", f"""with {KEPT}, s as (select cut_mask node, cut_mask | (6::bigint << 4) split, (cut_mask | (2::bigint << 4)) & ~(4::bigint << 4) few from kept)
    select node cut_mask, f.h h_min, round(a.sse / (select sum(n) from cells) + {REG} * f.h, 9) bound
    from s join scored a on a.cut_mask = split join scored f on f.cut_mask = few""")
def part_bound(spark, sf):
    cells = single_cells(spark, sf)
    df = P.lower_bound(fx.SINGLE, kept(spark, sf, cells), cells, 1, 1, REG)
    return df.select("cut_mask", "h_min", F.round("bound", 9).alias("bound"))


@query("part_loss_summed", f"with {SINGLE} select cut_mask, h, round(sse, 6) sse from scored")
def part_loss_summed(spark, sf):
    """The route for large spaces: factors summed out one after the other."""
    boxes = P.box_moments(fx.SINGLE, single_cells(spark, sf))
    return P.space_errors(fx.SINGLE, boxes).select("cut_mask", "h", F.round("sse", 6).alias("sse"))


@query("part_loss_summed_profiles", f"with {MULTI} select profile_id, cut_mask, h, round(sse, 6) sse from scored")
def part_loss_summed_profiles(spark, sf):
    return P.space_errors(fx.MULTI, P.box_moments(fx.MULTI, multi_cells(spark, sf))).select("profile_id", "cut_mask", "h", F.round("sse", 6).alias("sse"))


# ---- sets of one profile ----------------------------------------------------------------------


@query("near_profile", f"with {KEPT} select cut_mask, h, round(q, 9) q from kept")
def near_profile(spark, sf):
    df = R.exhaustive_set(fx.SINGLE, single_cells(spark, sf), THETA, REG, FULL)
    return df.select("cut_mask", "h", F.round("q", 9).alias("q"))


@query("near_profile_budget", f"with {SINGLE} select cut_mask, h, round(q, 9) q from scored where q <= 0.008 and h <= 12")
def near_profile_budget(spark, sf):
    df = R.exhaustive_set(fx.SINGLE, single_cells(spark, sf), 0.008, REG, FULL, max_pools=12)
    return df.select("cut_mask", "h", F.round("q", 9).alias("q"))


@query("near_frontier", f"with {KEPT} select cut_mask, h, round(q, 9) q from kept")
def near_frontier(spark, sf):
    cells = single_cells(spark, sf)
    df = R.frontier_set(fx.SINGLE, cells, THETA, REG, FULL)
    return df.select("cut_mask", "h", F.round("q", 9).alias("q"))


@query("near_frontier_budget", f"with {SINGLE} select cut_mask, h, round(q, 9) q from scored where q <= 0.008 and h <= 12")
def near_frontier_budget(spark, sf):
    cells = single_cells(spark, sf)
    df = R.frontier_set(fx.SINGLE, cells, 0.008, REG, FULL, max_pools=12)
    return df.select("cut_mask", "h", F.round("q", 9).alias("q"))


WIDE_THETA, WIDE_REG = 0.0056, 1e-4


@query("near_frontier_wide", f"with {S.wide_scores(fx.WIDE, 'wide', WIDE_REG)} select cast(cut_mask as bigint) cut_mask, h, round(q, 9) q from scored where q <= {WIDE_THETA}")
def near_frontier_wide(spark, sf):
    """Six factors, 2^20 partitions over 5400 cells: only the bound makes the search small."""
    cells = C.cell_table(fx.WIDE, fx.lineitem_wide(spark, sf))
    df = R.frontier_set(fx.WIDE, cells, WIDE_THETA, WIDE_REG, fx.WIDE.full_profile)
    return df.select("cut_mask", "h", F.round("q", 9).alias("q"))


@query("near_profile_wide", f"with {S.wide_scores(fx.EIGHT, 'eight', 1e-5)} select cast(cut_mask as bigint) cut_mask, h, round(q, 9) q from scored where q <= 0.012")
def near_profile_wide(spark, sf):
    """Eight factors of three levels each: 65,536 partitions over 6,561 cells, all of them scored."""
    cells = C.cell_table(fx.EIGHT, fx.lineitem_eight(spark, sf))
    df = R.exhaustive_set(fx.EIGHT, cells, 0.012, 1e-5, fx.EIGHT.full_profile)
    return df.select("cut_mask", "h", F.round("q", 9).alias("q"))


@query("near_members", f"""with {KEPT}, other as (select * from scored where h <= 8)
    select cut_mask, h, cut_mask in (select cut_mask from other) in_both from (select cut_mask, h from kept union select cut_mask, h from other)
    where cut_mask in (select cut_mask from kept)""")
def near_members(spark, sf):
    a = kept(spark, sf)
    b = P.enumerate_partitions(spark, fx.SINGLE, FULL).where(F.col("h") <= 8)
    union = R.unique_partitions(a.select("profile_id", "cut_mask", "h"), b)
    mine = R.members_of(union, a)
    both = R.members_of(mine, b).select("cut_mask", F.lit(True).alias("_b"))
    return mine.join(both, "cut_mask", "left").select("cut_mask", "h", F.coalesce("_b", F.lit(False)).alias("in_both"))


@query("near_order", f"""with {SINGLE} select cut_mask, round(q, 9) q, row_number() over (order by round(q, 12), cut_mask) position from scored""")
def near_order(spark, sf):
    df = P.score_partitions(fx.SINGLE, P.enumerate_partitions(spark, fx.SINGLE, FULL), single_cells(spark, sf), REG)
    return R.order_by_loss(materialize(df, "scored")).select("cut_mask", F.round("q", 9).alias("q"), "position")


_HALF = lambda status: f"select {S.QTY} qty, {S.DISC} disc, {S.TAX} tax, {S.FLAG} flag, {S.OUTCOME} y from lineitem where l_linestatus = '{status}'"


@query("near_rescore", f"""with {S.scores(fx.SINGLE, _HALF('O'), REG, FULL)}, first as (
        with {S.scores(fx.SINGLE, _HALF('F'), REG, FULL)} select cut_mask, q from scored where q <= {THETA})
    select cut_mask, round(first.q, 9) q_first, round(scored.q, 9) q_other from first join scored using (cut_mask)""")
def near_rescore(spark, sf):
    """The set found on one half of the facts, scored on the other half."""
    facts = read_table(spark, sf, "lineitem")
    def half(status):
        rows = facts.where(F.col("l_linestatus") == status).select(
            fx.qty_level().alias("qty"), fx.disc_level().alias("disc"), fx.tax_level().alias("tax"), fx.flag_level().alias("flag"), fx.outcome().alias("y"))
        return C.cell_table(fx.SINGLE, rows)
    first = materialize(R.exhaustive_set(fx.SINGLE, half("F"), THETA, REG, FULL), "first")
    again = P.score_partitions(fx.SINGLE, first.select("profile_id", "cut_mask"), half("O"), REG)
    return first.select("cut_mask", F.round("q", 9).alias("q_first")).join(again.select("cut_mask", F.round("q", 9).alias("q_other")), "cut_mask")


@query("near_equal", f"with {KEPT} select count(*) n_set, 0 n_different from kept")
def near_equal(spark, sf):
    cells = single_cells(spark, sf)
    a = materialize(R.exhaustive_set(fx.SINGLE, cells, THETA, REG, FULL), "a")
    b = R.frontier_set(fx.SINGLE, cells, THETA, REG, FULL)
    return a.agg(F.count("*").alias("n_set")).withColumn("n_different", R.set_difference(a, b).agg(F.count("*").cast("int")).scalar())


@query("near_theta_curve", f"""with {SINGLE}, b as (select min(q) q0 from scored)
    select cast(m as double) multiplier, count(*) n_partitions, cast(max(h) as bigint) max_h
    from scored, b, (values (1.05), (1.15), (1.33), (1.7), (2.1)) t(m) where q <= m * q0 group by m""")
def near_theta_curve(spark, sf):
    scored = materialize(P.score_partitions(fx.SINGLE, P.enumerate_partitions(spark, fx.SINGLE, FULL), single_cells(spark, sf), REG), "scored")
    return R.theta_curve(scored, [1.05, 1.15, 1.33, 1.7, 2.1])


@query("near_expand", f"""with {SINGLE}, t as (select min(q) best, min(q) filter (h = 15) hit from scored),
    steps as (select cast(0.0003 as double) + range * cast(0.0005 as double) theta from range(2000)),
    stop as (select min(theta) theta from steps, t where hit <= theta or theta >= 1.2 * (case when best <= theta then best else theta end))
    select cut_mask, h, round(theta, 6) theta from scored, stop where q <= theta""")
def near_expand(spark, sf):
    """Grow the threshold until a partition with 15 pools is in the set."""
    scored = P.score_partitions(fx.SINGLE, P.enumerate_partitions(spark, fx.SINGLE, FULL), single_cells(spark, sf), REG)
    theta, df = R.expanding_threshold(scored, 0.0003, 0.0005, 1.2, found=F.col("h") == 15)
    return df.select("cut_mask", "h", F.round(F.lit(theta), 6).alias("theta"))


# ---- models over profiles ---------------------------------------------------------------------


@query("near_models", f"with {MODELS} select model_key, round(loss, 9) loss, n_pools from models")
def near_models(spark, sf):
    return multi_models(spark, sf).select("model_key", F.round("loss", 9).alias("loss"), "n_pools")


@query("near_models_frontier", f"with {MODELS} select model_key, round(loss, 9) loss, n_pools from models")
def near_models_frontier(spark, sf):
    return multi_models(spark, sf, adaptive=True).select("model_key", F.round("loss", 9).alias("loss"), "n_pools")


@query("near_models_budget", f"""with {S.models(fx.MULTI, 'multi', REG_M, THETA_M, 13)} select model_key, round(loss, 9) loss, n_pools from models""")
def near_models_budget(spark, sf):
    return multi_models(spark, sf, max_pools=13).select("model_key", F.round("loss", 9).alias("loss"), "n_pools")


@query("near_models_wide", f"""with {S.models(fx.MULTI, 'multi', REG_M, 0.0222)}
    select n_pools, count(*) n_models, round(min(loss), 9) best from models group by n_pools""")
def near_models_wide(spark, sf):
    """A looser threshold with tens of thousands of models, summarised by size."""
    df = M.near_optimal_models(fx.MULTI, multi_cells(spark, sf), 0.0222, REG_M)
    return df.groupBy("n_pools").agg(F.count("*").alias("n_models"), F.round(F.min("loss"), 9).alias("best"))


_BETWEEN = f"""{MODELS}, lowest as (select profile_id, min(q) mq from scored group by 1),
    fits as (select s.profile_id, s.cut_mask, s.h from scored s join lowest l using (profile_id)
        where s.q + (select sum(mq) from lowest) - l.mq <= {THETA_M})"""


@query("near_used", f"with {_BETWEEN} select profile_id, cut_mask, h from fits")
def near_used(spark, sf):
    cells = multi_cells(spark, sf)
    sets = materialize(M.profile_sets(fx.MULTI, cells, THETA_M, REG_M), "sets")
    return M.usable_items(sets, _observed(cells), THETA_M).select("profile_id", "cut_mask", "h")


def _observed(cells):
    return cells.select("profile_id").distinct().count()


@query("near_used_budget", f"""with {S.models(fx.MULTI, "multi", REG_M, THETA_M, USED_POOLS)}, used as (select distinct unnest(string_split(model_key, '|')) x from models)
    select cast(split_part(x, ':', 1) as int) profile_id, cast(split_part(x, ':', 2) as bigint) cut_mask from used""")
def near_used_budget(spark, sf):
    """Partitions of models within a pool budget, from fronts of loss and pools; no model is made."""
    cells = multi_cells(spark, sf)
    sets = materialize(M.profile_sets(fx.MULTI, cells, THETA_M, REG_M, USED_POOLS), "sets")
    return M.usable_items(sets, _observed(cells), THETA_M, USED_POOLS).select("profile_id", "cut_mask")


@query("near_used_prefix", f"""with {_BETWEEN}, last as (select profile_id, max(round(q, 12)) top from scored semi join fits using (profile_id, cut_mask) group by 1)
    select s.profile_id, s.cut_mask, s.h from scored s join last using (profile_id) where round(s.q, 12) <= top""")
def near_used_prefix(spark, sf):
    cells = multi_cells(spark, sf)
    sets = materialize(M.profile_sets(fx.MULTI, cells, THETA_M, REG_M), "sets")
    found = M.near_optimal_models(fx.MULTI, cells, THETA_M, REG_M, sets=sets)
    return M.used_prefix(sets, found).select("profile_id", "cut_mask", "h")


@query("near_model_summary", f"""with {MODELS} select count(*) n_models, round(min(loss), 9) q0, round((max(loss) - min(loss)) / min(loss), 9) eps,
    (select model_key from models order by round(loss, 12), model_key limit 1) map_model from models""")
def near_model_summary(spark, sf):
    return rounded(M.model_summary(multi_models(spark, sf)), 9)


@query("source_model_set_members", f"""with {MODELS}, parts_of as (select model_key, loss, n_pools, unnest(string_split(model_key, '|')) x from models)
    select 'quantity' outcome, 'base' config, 'line items' label, model_key, cast(split_part(x, ':', 1) as int) profile_id, cast(split_part(x, ':', 2) as bigint) cut_mask,
        round(loss, 9) loss, n_pools, round((select min(loss) from models), 9) q0, (select count(*) from scored s semi join parts_of p on p.x = s.profile_id || ':' || s.cut_mask) n_partitions from parts_of""")
def source_model_set_members(spark, sf):
    """Partitions, models, members and parameters after saving and loading."""
    cells = multi_cells(spark, sf)
    sets = materialize(M.profile_sets(fx.MULTI, cells, THETA_M, REG_M), "sets")
    models = materialize(M.near_optimal_models(fx.MULTI, cells, THETA_M, REG_M, sets=sets), "models")
    path = scratch_path(spark, "modelset")
    best = models.agg(F.min("loss")).first()[0]
    save_model_set(path, "quantity", "base", M.used_partitions(sets, models), models, {"label": "line items", "q0": best})
    saved = load_model_set(spark, path, "quantity", "base")
    members = saved["models"].select("outcome", "config", "model_key", "loss", "n_pools", F.explode("members").alias("_m"))
    return (members.join(saved["parameters"], ["outcome", "config"])
            .withColumn("n_partitions", saved["partitions"].agg(F.count("*")).scalar())
            .select("outcome", "config", "label", "model_key", "_m.*", F.round("loss", 9).alias("loss"), "n_pools", F.round("q0", 9).alias("q0"), "n_partitions"))


@query("near_pruned", f"with {MODELS} select model_key, round(loss, 9) loss from models where loss <= (select min(loss) from models) * 1.05")
def near_pruned(spark, sf):
    return M.prune_by_epsilon(multi_models(spark, sf), 0.05).select("model_key", F.round("loss", 9).alias("loss"))


@query("near_global_pools", f"""with {MULTI}, best as (select profile_id, arg_min(cut_mask, (round(q, 12), cut_mask)) cut_mask from scored group by 1),
    ids as (select p.profile_id, p.cut_mask, p.pool_id, p.n from pooled p semi join best using (profile_id, cut_mask))
    select profile_id, pool_id, n, dense_rank() over (order by profile_id, pool_id) - 1 global_pool from ids""")
def near_global_pools(spark, sf):
    """Pools of the best model, numbered over all profiles."""
    cells = multi_cells(spark, sf)
    scored = P.score_partitions(fx.MULTI, P.enumerate_partitions(spark, fx.MULTI), cells, REG_M)
    best = (scored.join(cells.select("profile_id").distinct(), "profile_id", "left_semi").groupBy("profile_id")
            .agg(F.min_by("cut_mask", F.struct(F.round("q", 12), "cut_mask")).alias("cut_mask")))
    pools = P.assign_pools(fx.MULTI, best).join(cells.select("policy_id", "n"), "policy_id").groupBy("profile_id", "pool_id").agg(F.sum("n").alias("n"))
    return M.global_pool_ids(pools).select("profile_id", "pool_id", "n", "global_pool")


@query("near_describe", f"""with {KEPT} select a.cut_mask, a.pool_id, string_agg(a.policy_id, ',' order by a.policy_id) policies, p.n, round(p.mean_y, 6) mean_y
    from assigned a join pooled p using (cut_mask, pool_id) where a.cut_mask in (select cut_mask from kept) group by all""")
def near_describe(spark, sf):
    cells = single_cells(spark, sf)
    sets = kept(spark, sf, cells)
    boxes = P.box_moments(fx.SINGLE, cells).select("box_id", "n", "mean_y")
    assigned = P.assign_pools(fx.SINGLE, sets).join(boxes, "box_id").join(cells.select("policy_id"), "policy_id", "left_semi")
    return M.describe_pools(fx.SINGLE, assigned).select("cut_mask", "pool_id", F.array_join("policies", ",").alias("policies"), "n", F.round("mean_y", 6).alias("mean_y"))


# ---- strata and batches ------------------------------------------------------------------------

REG_S, EPS_S = 0.02, 1.012
_STRATA = S.scores(fx.ORDERS, "orders", REG_S, 7, by="segment", total_by_group=False)


def _strata(spark, sf):
    """Cells by segment and over all segments, losses by segment, and 1.012 times the best stratified loss."""
    both = materialize(C.stratified_cells(fx.ORDERS, fx.orders_strata(spark, sf), "segment").withColumn("profile_id", fx.ORDERS.profile_of_policy()), "cells")
    cells, together = both.where("segment is not null"), both.where("segment is null").drop("segment")
    scored = M.stratified_scores(fx.ORDERS, cells, "segment", REG_S, 7)
    theta = scored.groupBy("segment").agg(F.min("q").alias("b")).agg(F.sum("b")).first()[0] * EPS_S
    return cells, together, scored, theta


def strata_collapsed(spark, sf):
    """Stratified models, those alike in all strata replaced by the pooled one, and both cell tables."""
    cells, together, scored, theta = _strata(spark, sf)
    found = M.stratified_models(fx.ORDERS, scored, "segment", fx.SEGMENTS, theta)
    pooled = R.exhaustive_set(fx.ORDERS, together, theta, REG_S, 7)
    return M.collapse_homogeneous(found, pooled, len(fx.SEGMENTS)), cells, together


_STRATA_MODELS = f"""{_STRATA}, b as (select sum(mq) * {EPS_S} theta from (select min(q) mq from scored group by segment)),
    models as (select '0:' || s0.cut_mask || '|1:' || s1.cut_mask || '|2:' || s2.cut_mask || '|3:' || s3.cut_mask || '|4:' || s4.cut_mask model_key,
        s0.q + s1.q + s2.q + s3.q + s4.q loss, cast(s0.h + s1.h + s2.h + s3.h + s4.h as bigint) n_pools,
        case when s0.cut_mask = s1.cut_mask and s0.cut_mask = s2.cut_mask and s0.cut_mask = s3.cut_mask and s0.cut_mask = s4.cut_mask then s0.cut_mask end one
        from b, {', '.join(f"(select * from scored where segment = '{v}' and q <= (select min(q) from scored where segment = '{v}') + (select theta * (1 - 1 / {EPS_S}) + 1e-9 from b)) s{i}" for i, v in enumerate(fx.SEGMENTS))}
        where s0.q + s1.q + s2.q + s3.q + s4.q <= theta)"""


@query("near_strata", f"with {_STRATA_MODELS} select model_key, round(loss, 8) loss, n_pools from models")
def near_strata(spark, sf):
    _, _, scored, theta = _strata(spark, sf)
    found = M.stratified_models(fx.ORDERS, scored, "segment", fx.SEGMENTS, theta)
    return found.select("model_key", F.round("loss", 8).alias("loss"), "n_pools")


@query("near_collapse", f"""with {_STRATA_MODELS}, pooled_set as (with {S.scores(fx.ORDERS, 'orders', REG_S, 7)} select cut_mask, q, h from scored, b where q <= theta)
    select case when p.cut_mask is null then model_key else '-1:' || one end model_key, p.cut_mask is not null is_pooled,
        round(coalesce(p.q, loss), 8) loss, coalesce(p.h, n_pools) n_pools from models left join pooled_set p on p.cut_mask = one""")
def near_collapse(spark, sf):
    return strata_collapsed(spark, sf)[0].select("model_key", "is_pooled", F.round("loss", 8).alias("loss"), "n_pools")


@query("post_effects_strata", f"""with {_STRATA_MODELS}, pooled_set as (with {S.scores(fx.ORDERS, 'orders', REG_S, 7)} select cut_mask, q, h from scored, b where q <= theta),
    fin as (select model_key, coalesce(p.q, loss) loss, p.cut_mask gmask from models left join pooled_set p on p.cut_mask = one),
    wts as (select *, exp((select min(loss) from fin) - loss) w from fin),
    own as (select w, cast(split_part(x, ':', 1) as int) slot, cast(split_part(x, ':', 2) as bigint) cut_mask from (select w, unnest(string_split(model_key, '|')) x from wts where gmask is null)),
    seg as (select * from (values {', '.join(f"({i}, '{v}')" for i, v in enumerate(fx.SEGMENTS))}) t(slot, segment)),
    gpool as (select g.cut_mask, {S.pool(fx.ORDERS, 'c', 'g.cut_mask')} pool_id, sum(c.sum_y) / sum(c.n) m from (select distinct gmask cut_mask from wts where gmask is not null) g, cells c group by 1, 2),
    fits as (select s.segment, a.policy_id, o.w, p.mean_y m from own o join seg s using (slot) join assigned a on a.segment = s.segment and a.cut_mask = o.cut_mask
            join pooled p on p.segment = a.segment and p.cut_mask = a.cut_mask and p.pool_id = a.pool_id
        union all select c.segment, c.policy_id, t.w, g.m from wts t join gpool g on g.cut_mask = t.gmask join cells c on g.pool_id = {S.pool(fx.ORDERS, 'c', 'g.cut_mask')})
    select segment, policy_id, round(sum(w * m) / sum(w), 7) beta from fits group by 1, 2""")
def post_effects_strata(spark, sf):
    """Posterior effects of each stratum; models alike in all strata speak with the pooled means."""
    models, cells, together = strata_collapsed(spark, sf)
    models = materialize(models, "models")
    beta = B.stratified_effects(fx.ORDERS, models, fx.SEGMENTS, "segment", P.box_moments(fx.ORDERS, cells, ["segment"]), P.box_moments(fx.ORDERS, together), 7)
    return beta.join(cells.select("segment", "policy_id"), ["segment", "policy_id"], "left_semi").select("segment", "policy_id", F.round("beta", 7).alias("beta"))


_STRATA_MEANS = f"""{_STRATA_MODELS}, pooled_set as (with {S.scores(fx.ORDERS, 'orders', REG_S, 7)} select cut_mask, q, h from scored, b where q <= theta),
    fin as (select model_key, coalesce(p.q, loss) loss, p.cut_mask gmask from models left join pooled_set p on p.cut_mask = one),
    wts as (select *, exp((select min(loss) from fin) - loss) w from fin),
    seg as (select * from (values {', '.join(f"({i}, '{v}')" for i, v in enumerate(fx.SEGMENTS))}) t(slot, segment)),
    masks as (select segment, false shared, cut_mask, sum(w) w from (select w, cast(split_part(x, ':', 1) as int) slot, cast(split_part(x, ':', 2) as bigint) cut_mask
            from (select w, unnest(string_split(model_key, '|')) x from wts where gmask is null)) join seg using (slot) group by all
        union all select segment, true, gmask, sum(w) from wts, seg where gmask is not null group by all),
    allc as (select *  from (select policy_id, {S.decode(fx.ORDERS)} from (select unnest(range({fx.ORDERS.n_policies})) policy_id)) where {' and '.join(f'{n} > 0' for n in fx.ORDERS.names)}),
    placed as (select m.*, c.*, {S.pool(fx.ORDERS, 'c', 'm.cut_mask')} pool_id from masks m, allc c),
    pmeans as (select segment, shared, cut_mask, pool_id, sum(sum_y) / sum(n) mean_y from placed p join (select segment seg, policy_id, sum_y, n from cells) c on c.policy_id = p.policy_id and (shared or c.seg = p.segment) group by all),
    fitted as (select placed.*, coalesce(mean_y, 0) mean_y from placed left join pmeans using (segment, shared, cut_mask, pool_id)),
    vs as ({' union all '.join(f"select a.segment, a.w, '{n}' factor, a.{n} lev, case when a.pool_id = b.pool_id then 0.0 else a.mean_y - b.mean_y end effect from fitted a join fitted b on a.segment = b.segment and a.shared = b.shared and a.cut_mask = b.cut_mask and b.{n} = 1 and a.{n} > 1 and " + ' and '.join(f'a.{o} = b.{o}' for o in fx.ORDERS.names if o != n) for n in fx.ORDERS.names)}),
    sig as (select segment, factor, stddev_pop(effect) sigma from vs group by 1, 2),
    binned as (select vs.*, case when effect = 0 then 2 when effect >= 2 * sigma then 0 when effect > 0 then 1 when effect >= -2 * sigma then 3 else 4 end bin from vs join sig using (segment, factor))"""


@query("post_effects_vs_base_strata", f"""with {_STRATA_MEANS} select segment, factor, lev as level, round(sum(w * effect) / sum(w), 7) + 0.0 mean_effect,
    {', '.join(f'round(sum(case when bin = {b} then w else 0.0 end) / sum(w), 7) bin_{b}' for b in range(5))} from binned group by 1, 2, 3""")
def post_effects_vs_base_strata(spark, sf):
    """Effects of levels per stratum over stratified models, those alike in all strata collapsed, and their sigma bins."""
    models, cells, together = strata_collapsed(spark, sf)
    effects = materialize(B.stratified_effects_vs_base(fx.ORDERS, materialize(models, "models"), fx.SEGMENTS, "segment", P.box_moments(fx.ORDERS, cells, ["segment"]),
                                                       P.box_moments(fx.ORDERS, together), 7), "effects")
    by = ["segment", "factor", "level"]
    mass = F.col("weight") * F.col("n_cells")
    means = effects.groupBy(*by).agg((F.round(F.sum(mass * F.col("effect")) / F.sum(mass), 7) + 0.0).alias("mean_effect"))
    return means.join(rounded(B.effect_histogram(effects, by, by[:2]), 7), by)


_OUTCOMES = ["value", "root_value", "props_size"]
_BATCH_OBS = f"""select etype, daypart, outcome, y from (unpivot ({S.OBS['events']}) on value, root_value, props_size into name outcome value y)"""


@query("near_batch", f"""with {S.scores(fx.EVENTS, _BATCH_OBS, 0.01, 3, by='outcome')}
    select outcome, cut_mask, h, round(q, 7) q from scored""")
def near_batch(spark, sf):
    """Three outcomes in one job."""
    obs = prep.melt_outcomes(fx.events_design(spark, sf), ["etype", "daypart"], _OUTCOMES)
    cells = C.cell_table(fx.EVENTS, obs, by=["outcome"])
    scored = R.batch_scores(fx.EVENTS, cells, ["outcome"], 0.01, 3)
    return scored.select("outcome", "cut_mask", "h", F.round("q", 7).alias("q"))


_RUNS_OBS = f"""select {S.STATUS} status, l_returnflag config, disc, tax, outcome, y from (
        select l_linestatus, l_returnflag, {S.DISC} disc, {S.TAX} tax, unnest(['quantity', 'price']) outcome, unnest([{S.OUTCOME}, l_extendedprice / 10000]) y from lineitem)"""
_RUNS = f"""obs as ({_RUNS_OBS}), cells as (select outcome, config, status, disc, tax, cast({S.policy(fx.TREAT)} as bigint) policy_id, cast({S.profile(fx.TREAT)} as int) profile_id,
        count(*) n, sum(y) sum_y, avg(y) mean_y, var_pop(y) * count(*) ssw from obs group by outcome, config, status, disc, tax), {S.masks(fx.TREAT)},
    pooled as (select c.outcome, c.config, p.profile_id, p.cut_mask, p.h, {S.pool(fx.TREAT, 'c', 'p.cut_mask')} pool_id,
        greatest(sum(n * mean_y * mean_y) - sum(sum_y) * sum(sum_y) / sum(n), 0) + sum(ssw) sse from parts p join cells c using (profile_id) group by 1, 2, 3, 4, 5, 6),
    totals as (select outcome, config, sum(n) total from cells group by 1, 2)"""


_RUN_MODELS = f"""{_RUNS}, scored as (select outcome, config, profile_id, cut_mask, h, sum(sse) / any_value(total) + 0.001 * h q from pooled join totals using (outcome, config) group by 1, 2, 3, 4, 5),
    theta as (select outcome, config, sum(mq) * 1.02 theta from (select outcome, config, profile_id, min(q) mq from scored group by 1, 2, 3) group by 1, 2),
    models as (select a.outcome, a.config, '3:' || a.cut_mask || '|7:' || b.cut_mask model_key, a.q + b.q loss, cast(a.h + b.h as bigint) n_pools from scored a join scored b using (outcome, config) join theta using (outcome, config)
        where a.profile_id = 3 and b.profile_id = 7 and a.q + b.q <= theta and a.h + b.h <= 9)"""


def _run_cells(spark, sf):
    facts = read_table(spark, sf, "lineitem").select(
        prep.recode("l_linestatus", {"F": 0, "O": 1}).alias("status"), F.col("l_returnflag").alias("config"), fx.disc_level().alias("disc"),
        fx.tax_level().alias("tax"), fx.outcome().alias("quantity"), (F.col("l_extendedprice") / 10000).alias("price"))
    obs = prep.melt_outcomes(facts, ["status", "disc", "tax", "config"], ["quantity", "price"])
    return C.cell_table(fx.TREAT, obs, by=["outcome", "config"])


def _run_models(spark, sf):
    keys = ["outcome", "config"]
    cells = _run_cells(spark, sf)
    scored = materialize(R.batch_scores(fx.TREAT, cells, keys, 1e-3), "scores")
    theta = (scored.groupBy(*keys, "profile_id").agg(F.min("q").alias("_q")).groupBy(*keys).agg((F.sum("_q") * 1.02).alias("theta")))
    return M.near_optimal_models_by(fx.TREAT, cells, keys, materialize(theta, "theta"), 1e-3, max_pools=9, scored=scored)


@query("near_batch_models", f"with {_RUN_MODELS} select outcome, config, model_key, round(loss, 8) loss, n_pools from models")
def near_batch_models(spark, sf):
    """Models of every outcome and configuration, each under its own threshold, in one job."""
    return _run_models(spark, sf).select("outcome", "config", "model_key", F.round("loss", 8).alias("loss"), "n_pools")


@query("near_batch_summary", f"""with {_RUN_MODELS} select outcome, config, count(*) n_models, round(min(loss), 8) q0, round((max(loss) - min(loss)) / min(loss), 6) eps,
    arg_min(model_key, (round(loss, 12), model_key)) map_model from models group by 1, 2""")
def near_batch_summary(spark, sf):
    df = M.model_summary(materialize(_run_models(spark, sf), "models"), ["outcome", "config"])
    return df.withColumns({"q0": F.round("q0", 8), "eps": F.round("eps", 6)})


@query("near_batch_configs", f"""with {_RUNS} select outcome, config, profile_id, cut_mask, h, round(sum(sse) / any_value(total) + 0.001 * h, 7) q
    from pooled join totals using (outcome, config) group by 1, 2, 3, 4, 5""")
def near_batch_configs(spark, sf):
    """Outcomes by configurations, all profiles, in one job."""
    scored = R.batch_scores(fx.TREAT, _run_cells(spark, sf), ["outcome", "config"], 1e-3)
    return scored.select("outcome", "config", "profile_id", "cut_mask", "h", F.round("q", 7).alias("q"))
