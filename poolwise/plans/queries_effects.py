"""Queries: treatment effects, posterior summaries and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwise.functions import metrics as X, posterior as B
from poolwise.operators import cells as C, design as D, models as M, partitions as P, search as R, treatment as T
from poolwise.plans import fixtures as fx, sql as S
from poolwise.plans.queries_sets import FULL, KEPT, MODELS, REG, REG_M, SINGLE, THETA_M, kept, multi_cells, multi_models, single_cells
from poolwise.plans.registry import query, rounded
from poolwise.runtime import materialize, scalar

# ---- treatment effects -------------------------------------------------------------------------

REG_T, THETA_T = 1e-4, 0.08218
REG_U, THETA_U = 1e-4, 0.0828

TREAT = S.scores(fx.TREAT, "treat", REG_T)
PAIRS = f"""{TREAT}, pairs as (select c.cut_mask mask_c, t.cut_mask mask_t, c.sse + t.sse sse, c.h + t.h h from scored c join scored t
        on c.profile_id = 3 and t.profile_id = 7 and c.q + t.q <= {THETA_T}),
    side as (select p.mask_t, p.mask_c, c.policy_id, c.profile_id, c.disc * 4 + c.tax rest_id, c.n, c.sum_y, c.mean_y,
        {S.pool(fx.TREAT, 'c', 'case when c.profile_id = 7 then p.mask_t else p.mask_c end')} pool_id from pairs p, cells c),
    lows as (select mask_t, mask_c, profile_id, pool_id, cast(min(policy_id) as bigint) low, cast(sum(n) as bigint) n, sum(sum_y) s, sum(sum_y) / sum(n) mean_y
        from side group by all),
    marked as (select s.mask_t, s.mask_c, s.policy_id, s.profile_id, s.rest_id, l.low, l.n pool_n, l.mean_y pool_mean from side s join lows l using (mask_t, mask_c, profile_id, pool_id)),
    edges as (select distinct t.mask_t, t.mask_c, t.low low_t, c.low low_c, t.pool_n n_t, c.pool_n n_c, t.pool_mean m_t, c.pool_mean m_c
        from marked t join marked c on t.mask_t = c.mask_t and t.mask_c = c.mask_c and t.rest_id = c.rest_id and t.profile_id = 7 and c.profile_id = 3),
    costs as (select *, (n_t * m_t * m_t + n_c * m_c * m_c) - (n_t * m_t + n_c * m_c) * (n_t * m_t + n_c * m_c) / (n_t + n_c) d_sse from edges)"""


def _low(spec, box):
    """Smallest cell of a box, as a name that both sides know."""
    return F.expr(spec.policy_sql([spec.box_low_sql(i, box) for i in range(spec.m)]))


def _treat(spark, sf):
    cells = C.cell_table(fx.TREAT, fx.lineitem_treatment(spark, sf))
    sets = materialize(M.profile_sets(fx.TREAT, cells, THETA_T, REG_T), "sets")
    models = materialize(M.near_optimal_models(fx.TREAT, cells, THETA_T, REG_T, sets=sets), "models")
    boxes = materialize(P.box_moments(fx.TREAT, cells), "boxes")
    return cells, M.model_members(models), sets, boxes


@query("te_overlap", f"with {PAIRS} select mask_t, mask_c, low_t, low_c from edges")
def te_overlap(spark, sf):
    _, members, _, _ = _treat(spark, sf)
    found = T.overlap(fx.TREAT, T.partition_pairs(fx.TREAT, members, "status"), "status")
    return found.select("mask_t", "mask_c", _low(fx.TREAT, "box_t").alias("low_t"), _low(fx.TREAT, "box_c").alias("low_c"))


@query("te_merge_cost", f"with {PAIRS} select mask_t, mask_c, low_t, low_c, round(d_sse, 6) d_sse from costs")
def te_merge_cost(spark, sf):
    _, members, _, boxes = _treat(spark, sf)
    costs = T.merge_costs(fx.TREAT, T.overlap(fx.TREAT, T.partition_pairs(fx.TREAT, members, "status"), "status"), boxes)
    return costs.select("mask_t", "mask_c", _low(fx.TREAT, "box_t").alias("low_t"), _low(fx.TREAT, "box_c").alias("low_c"),
                        (F.round("d_sse", 6) + 0.0).alias("d_sse"))


@query("te_merged_pools", f"""with {PAIRS}, cheapest as (select mask_t, mask_c, arg_min(low_t, (round(d_sse, 9), low_t, low_c)) low_t, arg_min(low_c, (round(d_sse, 9), low_t, low_c)) low_c from costs group by all),
    joined as (select l.mask_t, l.mask_c, coalesce(c.low_c, l.low) merged, l.n, l.s from lows l left join cheapest c on l.mask_t = c.mask_t and l.mask_c = c.mask_c and l.low = c.low_t)
    select mask_t, mask_c, merged, cast(sum(n) as bigint) n, round(sum(s) / sum(n), 6) mean_y from joined group by all""")
def te_merged_pools(spark, sf):
    """Each pair with its cheapest merge carried out."""
    _, members, _, boxes = _treat(spark, sf)
    pairs = T.partition_pairs(fx.TREAT, members, "status")
    costs = T.merge_costs(fx.TREAT, T.overlap(fx.TREAT, pairs, "status"), boxes)
    keys = ["rest_profile", "mask_t", "mask_c"]
    order = F.struct(F.round("d_sse", 9), _low(fx.TREAT, "box_t"), _low(fx.TREAT, "box_c"))
    cheapest = costs.groupBy(*keys).agg(F.min_by(F.struct("box_t", "box_c"), order).alias("_m")).select(*keys, "_m.*")
    pools = T.merged_assignment(fx.TREAT, pairs, "status", cheapest).join(boxes.select("box_id", "n", "sum_y"), "box_id")
    return (pools.groupBy("mask_t", "mask_c", _low(fx.TREAT, "merged_box").alias("merged"))
            .agg(F.sum("n").alias("n"), F.round(F.sum("sum_y") / F.sum("n"), 6).alias("mean_y")))


_RECURSION = """ranked as (select *, dense_rank() over (partition by mask_t, mask_c order by low_t) k from costs),
    walk as (select mask_t, mask_c, 0 k, cast([] as bigint[]) used, cast('' as varchar) merges, sse, h from pairs
        union all
        select w.mask_t, w.mask_c, w.k + 1, case when o.low_c is null then w.used else list_append(w.used, o.low_c) end,
            case when o.low_c is null then w.merges else w.merges || o.low_t || '~' || o.low_c || ',' end,
            w.sse + coalesce(o.d_sse, 0), w.h - (case when o.low_c is null then 0 else 1 end)
        from walk w join (select mask_t, mask_c, k, low_t, low_c, d_sse from ranked union all
            select mask_t, mask_c, k, null, null, null from ranked group by all) o
        on o.mask_t = w.mask_t and o.mask_c = w.mask_c and o.k = w.k + 1 and (o.low_c is null or not list_contains(w.used, o.low_c))),
    ends as (select w.* from walk w join (select mask_t, mask_c, max(k) top from ranked group by all) r on w.mask_t = r.mask_t and w.mask_c = r.mask_c and w.k = r.top)"""


def _merge_names(spec):
    low = lambda f: spec.policy_sql([spec.box_low_sql(i, f"m.{f}") for i in range(spec.m)])
    return F.expr(f"array_join(transform(array_sort(transform(merges, m -> named_struct('a', {low('box_t')}, 'b', {low('box_c')}))), "
                  "s -> concat(s.a, '~', s.b, ',')), '')")


@query("te_search", f"""with recursive {PAIRS}, {_RECURSION}
    select mask_t, mask_c, merges, cast(h as bigint) h, round(sse / (select sum(n) from cells) + {REG_T} * h, 9) q from ends
    where sse / (select sum(n) from cells) + {REG_T} * h <= 0.08206""")
def te_search(spark, sf):
    cells, members, sets, boxes = _treat(spark, sf)
    base = materialize(T.pair_base(fx.TREAT, T.partition_pairs(fx.TREAT, members, "status"), sets, "status"), "base")
    costs = T.merge_costs(fx.TREAT, T.overlap(fx.TREAT, base, "status"), boxes)
    n = int(scalar(cells.agg(F.sum("n"))))
    found = T.search_merges(fx.TREAT, base, costs, n, 0.08206, REG_T)
    return found.select("mask_t", "mask_c", _merge_names(fx.TREAT).alias("merges"), F.col("h").cast("long").alias("h"), F.round("q", 9).alias("q"))


@query("te_search_single_merge", f"""with recursive {PAIRS}, {_RECURSION}
    select mask_t, mask_c, merges, cast(h as bigint) h, round(sse / (select sum(n) from cells) + (case when merges = '' then {REG_T} else 0.0002 end) * h, 9) q from ends
    where len(used) <= 1 and sse / (select sum(n) from cells) + (case when merges = '' then {REG_T} else 0.0002 end) * h <= 0.0824""")
def te_search_single_merge(spark, sf):
    """At most one merge, and another penalty once something is merged."""
    cells, members, sets, boxes = _treat(spark, sf)
    base = materialize(T.pair_base(fx.TREAT, T.partition_pairs(fx.TREAT, members, "status"), sets, "status"), "base")
    costs = T.merge_costs(fx.TREAT, T.overlap(fx.TREAT, base, "status"), boxes)
    n = int(scalar(cells.agg(F.sum("n"))))
    found = T.search_merges(fx.TREAT, base, costs, n, 0.0824, REG_T, max_merges=1, merge_reg=0.0002)
    return found.select("mask_t", "mask_c", _merge_names(fx.TREAT).alias("merges"), F.col("h").cast("long").alias("h"), F.round("q", 9).alias("q"))


MODELS_U = S.models(fx.TREAT2, "treat2", REG_U, THETA_U)
# every model's four (treated, control) pairs, from its key
_MEMBERS_U = f"""{MODELS_U}, parts_of as (select model_key, loss, cast(split_part(x, ':', 1) as int) profile_id, cast(split_part(x, ':', 2) as bigint) cut_mask
        from (select model_key, loss, unnest(string_split(model_key, '|')) x from models)),
    model_pairs as (select t.model_key, t.loss, c.profile_id rest_profile, t.cut_mask mask_t, c.cut_mask mask_c from parts_of t join parts_of c
        on t.model_key = c.model_key and t.profile_id = c.profile_id + 4)"""
# TREAT2 has one factor with cuts (disc, bits 0-1); pools of a side are its disc segments
_SEG = "cast(bit_count({m} & 3 & ((1 << greatest(disc - 1, 0)) - 1)) as bigint)"
_SWEEP = f"""{_MEMBERS_U}, pairs as (select distinct p.rest_profile, p.mask_t, p.mask_c, t.sse + c.sse sse, t.h + c.h h from model_pairs p
        join scored t on t.profile_id = p.rest_profile + 4 and t.cut_mask = p.mask_t join scored c on c.profile_id = p.rest_profile and c.cut_mask = p.mask_c),
    side as (select p.rest_profile, p.mask_t, p.mask_c, c.status, c.disc, c.policy_id, c.n, c.sum_y,
        (case when c.status = 1 then {_SEG.format(m='p.mask_t')} else {_SEG.format(m='p.mask_c')} end) seg
        from pairs p join cells c on c.profile_id in (p.rest_profile, p.rest_profile + 4) where p.rest_profile in (1, 3)),
    lows as (select rest_profile, mask_t, mask_c, status, seg, cast(min(policy_id) as bigint) low, sum(n) n, sum(sum_y) / sum(n) m from side group by all),
    marked as (select s.*, l.low, l.n pool_n, l.m from side s join lows l using (rest_profile, mask_t, mask_c, status, seg)),
    costs as (select distinct t.rest_profile, t.mask_t, t.mask_c, t.low low_t, c.low low_c, t.pool_n * c.pool_n / (t.pool_n + c.pool_n) * (t.m - c.m) * (t.m - c.m) d_sse
        from marked t join marked c on t.rest_profile = c.rest_profile and t.mask_t = c.mask_t and t.mask_c = c.mask_c and t.disc = c.disc and t.status = 1 and c.status = 0),
    ranked as (select *, dense_rank() over (partition by rest_profile, mask_t, mask_c order by low_t) k from costs),
    walk as (select rest_profile, mask_t, mask_c, 0 k, cast([] as bigint[]) used, cast('' as varchar) merges, sse, h from pairs
        union all
        select w.rest_profile, w.mask_t, w.mask_c, w.k + 1, case when o.low_c is null then w.used else list_append(w.used, o.low_c) end,
            case when o.low_c is null then w.merges else w.merges || o.low_t || '~' || o.low_c || ',' end,
            w.sse + coalesce(o.d_sse, 0), w.h - (case when o.low_c is null then 0 else 1 end)
        from walk w join (select rest_profile, mask_t, mask_c, k, low_t, low_c, d_sse from ranked union all
            select rest_profile, mask_t, mask_c, k, null, null, null from ranked group by all) o
        on o.rest_profile = w.rest_profile and o.mask_t = w.mask_t and o.mask_c = w.mask_c and o.k = w.k + 1 and (o.low_c is null or not list_contains(w.used, o.low_c))),
    te_sets as (select w.rest_profile, w.mask_t, w.mask_c, w.merges, w.sse / (select sum(n) from cells) + {REG_U} * w.h q, cast(w.h as bigint) h
        from walk w left join (select rest_profile, mask_t, mask_c, max(k) top from ranked group by all) r using (rest_profile, mask_t, mask_c)
        where w.k = coalesce(r.top, 0) and w.sse / (select sum(n) from cells) + {REG_U} * w.h <= {THETA_U})"""
_THETA_C = 0.08252


def _sweep(spark, sf):
    cells = C.cell_table(fx.TREAT2, fx.lineitem_treatment2(spark, sf))
    sets = materialize(M.profile_sets(fx.TREAT2, cells, THETA_U, REG_U), "sets")
    models = materialize(M.near_optimal_models(fx.TREAT2, cells, THETA_U, REG_U, sets=sets), "models")
    boxes = materialize(P.box_moments(fx.TREAT2, cells), "boxes")
    n = int(scalar(cells.agg(F.sum("n"))))
    found = T.treatment_sets(fx.TREAT2, M.model_members(models), sets, boxes, "status", n, THETA_U, REG_U)
    return materialize(found, "te"), models, boxes


@query("te_sweep", f"with recursive {_SWEEP} select rest_profile, mask_t, mask_c, merges, h, round(q, 9) q from te_sets")
def te_sweep(spark, sf):
    found, _, _ = _sweep(spark, sf)
    return found.select("rest_profile", "mask_t", "mask_c", _merge_names(fx.TREAT2).alias("merges"), F.col("h").cast("long").alias("h"), F.round("q", 9).alias("q"))


@query("te_combine", f"""with recursive {_SWEEP} select round(a.q + b.q + c.q + d.q, 9) loss, a.h + b.h + c.h + d.h n_pools
    from te_sets a, te_sets b, te_sets c, te_sets d where a.rest_profile = 0 and b.rest_profile = 1 and c.rest_profile = 2 and d.rest_profile = 3
    and a.q + b.q + c.q + d.q <= {_THETA_C}""")
def te_combine(spark, sf):
    found, _, _ = _sweep(spark, sf)
    return T.combine_treatment_sets(fx.TREAT2, found, "status", _THETA_C).select(F.round("loss", 9).alias("loss"), "n_pools")


@query("te_usable", f"""with recursive {_SWEEP}, lowest as (select rest_profile, min(q) mq from te_sets group by 1)
    select rest_profile, mask_t, mask_c, merges, h from te_sets join lowest using (rest_profile) where (select sum(mq) from lowest) - mq + q <= {_THETA_C}""")
def te_usable(spark, sf):
    found, _, _ = _sweep(spark, sf)
    return T.usable_treatment_sets(found, _THETA_C).select("rest_profile", "mask_t", "mask_c", _merge_names(fx.TREAT2).alias("merges"), F.col("h").cast("long").alias("h"))


@query("te_matched", f"""with {S.cells(fx.TREAT2, 'treat2')} select c.policy_id control_id, t.policy_id treated_id, round(t.mean_y - c.mean_y, 6) effect
    from cells c join cells t on t.status = 1 and c.status = 0 and t.returned = c.returned and t.disc = c.disc""")
def te_matched(spark, sf):
    cells = C.cell_table(fx.TREAT2, fx.lineitem_treatment2(spark, sf))
    side = lambda k, m: cells.select(F.col("policy_id").alias(k), F.col("mean_y").alias(m))
    pairs = T.matched_cells(fx.TREAT2, cells.select("policy_id"), "status")
    return (pairs.join(side("control_id", "c"), "control_id").join(side("treated_id", "t"), "treated_id")
            .select("control_id", "treated_id", F.round(F.col("t") - F.col("c"), 6).alias("effect")))


_EFFECTS = f"""{PAIRS}, effects as (select t.mask_t, t.mask_c, c.policy_id control_id, t.pool_mean - c.pool_mean effect
    from marked t join marked c on t.mask_t = c.mask_t and t.mask_c = c.mask_c and t.rest_id = c.rest_id and t.profile_id = 7 and c.profile_id = 3)"""


@query("te_effects", f"with {_EFFECTS} select mask_t, mask_c, control_id, round(effect, 6) + 0.0 effect from effects")
def te_effects(spark, sf):
    _, members, _, boxes = _treat(spark, sf)
    found = T.pair_effects(fx.TREAT, T.partition_pairs(fx.TREAT, members, "status"), boxes, "status")
    return T.effects_by_cell(fx.TREAT, found).select("mask_t", "mask_c", "control_id", (F.round("effect", 6) + 0.0).alias("effect"))


@query("te_contrast", f"""with {_MEMBERS_U}, fit as (select m.model_key, p.profile_id, c.disc, c.status, c.returned, c.policy_id, pl.mean_y
        from model_pairs m join parts_of p using (model_key) join cells c on c.profile_id = p.profile_id
        join pooled pl on pl.profile_id = p.profile_id and pl.cut_mask = p.cut_mask and pl.pool_id = {S.pool(fx.TREAT2, 'c', 'p.cut_mask')} group by all),
    eff as (select t.model_key, c.policy_id control_id, c.disc, c.returned, t.mean_y - c.mean_y effect from fit t join fit c
        on t.model_key = c.model_key and t.disc = c.disc and t.returned = c.returned and t.status = 1 and c.status = 0)
    select a.model_key, a.control_id, round(a.effect - b.effect, 6) + 0.0 contrast from eff a join eff b on a.model_key = b.model_key and a.disc = b.disc and a.returned = 1 and b.returned = 0""")
def te_contrast(spark, sf):
    """Effect of the status for returned lines against the others, per model."""
    _, models, boxes = _sweep(spark, sf)
    pairs = T.partition_pairs(fx.TREAT2, M.model_members(models), "status", per_model=True)
    per_cell = T.effects_by_cell(fx.TREAT2, T.pair_effects(fx.TREAT2, pairs, boxes, "status"))
    found = T.effect_contrast(fx.TREAT2, per_cell, "returned", ["model_key"])
    return found.select("model_key", "control_id", (F.round("contrast", 6) + 0.0).alias("contrast"))


# each entry's cells with the mean of their pool after the merges
_MERGED = f"""{_SWEEP}, te as (select *, row_number() over (order by rest_profile, mask_t, mask_c, merges) id from te_sets),
    tcell as (select p.id, p.rest_profile, c.status, c.returned, c.disc, c.policy_id, c.n, c.sum_y,
        (case when c.status = 1 then {_SEG.format(m='p.mask_t')} else {_SEG.format(m='p.mask_c')} end) seg from te p join cells c on c.profile_id in (p.rest_profile, p.rest_profile + 4)),
    tlow as (select id, status, seg, cast(min(policy_id) as bigint) low, sum(n) n, sum(sum_y) s from tcell group by all),
    tmix as (select id, cast(split_part(x, '~', 1) as bigint) low_t, cast(split_part(x, '~', 2) as bigint) low_c
        from (select id, unnest(string_split(rtrim(merges, ','), ',')) x from te where merges <> '')),
    tpool as (select l.id, l.status, l.seg, l.n, l.s, coalesce(m.low_c, l.low) pool from tlow l left join tmix m on m.id = l.id and l.status = 1 and m.low_t = l.low),
    tmean as (select id, pool, sum(s) / sum(n) m from tpool group by all),
    tfit as (select c.*, p.pool, e.m from tcell c join tpool p on p.id = c.id and p.status = c.status and p.seg = c.seg join tmean e on e.id = p.id and e.pool = p.pool),
    teff as (select c.id, c.rest_profile, c.policy_id control_id, c.returned, c.disc, case when t.pool = c.pool then 0.0 else t.m - c.m end effect
        from tfit t join tfit c on t.id = c.id and t.status = 1 and c.status = 0 and t.returned = c.returned and t.disc = c.disc)"""
_COMBOS = f"""{_MERGED}, combos as (select a.id i0, b.id i1, c.id i2, d.id i3, exp(-(a.q + b.q + c.q + d.q)) w from te a, te b, te c, te d
        where a.rest_profile = 0 and b.rest_profile = 1 and c.rest_profile = 2 and d.rest_profile = 3 and a.q + b.q + c.q + d.q <= {_THETA_C})"""


def _bins(value: str) -> str:
    """Shares of weight by multiples of the spread, from rows(rest_profile, w, k, value)."""
    return f"""mid as (select sum(k * {value}) / sum(k) m from valued), sig as (select sqrt(sum(k * ({value} - m) * ({value} - m)) / sum(k)) s from valued, mid),
    binned as (select rest_profile, w, case when {value} = 0 then 2 when {value} >= 2 * s then 0 when {value} > 0 then 1 when {value} >= -2 * s then 3 else 4 end bin from valued, sig)
    select rest_profile, {', '.join(f'round(sum(case when bin = {b} then w else 0.0 end) / sum(w), 7) bin_{b}' for b in range(5))} from binned group by rest_profile"""


@query("te_effects_merged", f"with recursive {_MERGED} select rest_profile, mask_t, mask_c, merges, control_id, round(effect, 6) + 0.0 effect from teff join te using (id, rest_profile)")
def te_effects_merged(spark, sf):
    """Effects after the merges that the search has chosen."""
    found, _, boxes = _sweep(spark, sf)
    named = found.withColumn("names", _merge_names(fx.TREAT2))
    cells = T.effects_by_cell(fx.TREAT2, T.merged_effects(fx.TREAT2, named, boxes, "status"))
    return cells.select("rest_profile", "mask_t", "mask_c", F.col("names").alias("merges"), "control_id", (F.round("effect", 6) + 0.0).alias("effect"))


def _combined(found):
    return materialize(T.combine_treatment_sets(fx.TREAT2, found, "status", _THETA_C), "te-models")


@query("te_effect_histogram", f"""with recursive {_COMBOS}, used as (select id, sum(w) w, count(*) k from (select unnest([i0, i1, i2, i3]) id, w from combos) group by 1),
    valued as (select rest_profile, effect, w, k from teff join used using (id)), {_bins('effect')}""")
def te_effect_histogram(spark, sf):
    """Merged effects of all models, by weight and feature profile."""
    found, _, boxes = _sweep(spark, sf)
    entries = T.weighted_entries(found, _combined(found))
    effects = T.merged_effects(fx.TREAT2, entries, boxes, "status").withColumn("n", F.col("n_cells") * F.col("n_models"))
    return rounded(B.effect_histogram(effects, ["rest_profile"], [], count="n"), 7)


@query("te_contrast_histogram", f"""with recursive {_COMBOS}, used as (select lo, hi, sum(w) w, count(*) k from (select i0 lo, i2 hi, w from combos union all select i1, i3, w from combos) group by 1, 2),
    valued as (select l.rest_profile, h.effect - l.effect contrast, w, k from used u join teff l on l.id = u.lo join teff h on h.id = u.hi and h.disc = l.disc), {_bins('contrast')}""")
def te_contrast_histogram(spark, sf):
    """Merged effect for returned lines against the others, over all models."""
    found, _, boxes = _sweep(spark, sf)
    apart = T.weighted_contrasts(fx.TREAT2, found, _combined(found), boxes, "status", "returned")
    return rounded(B.effect_histogram(apart.withColumn("effect", F.col("contrast")), ["rest_profile"], [], count="n_models"), 7)


@query("te_table", f"""with obs as (select {S.STATUS} status, {S.DISC} disc, {S.TAX} tax, {S.OUTCOME} quantity, l_extendedprice / 10000 price from lineitem),
    c as (select status, disc, tax, avg(quantity) q, avg(price) p from obs group by all)
    select cast(a.disc * 4 + a.tax as bigint) control_id, round(b.q - a.q, 6) quantity, round(b.p - a.p, 6) price from c a join c b
        on a.status = 0 and b.status = 1 and a.disc = b.disc and a.tax = b.tax""")
def te_table(spark, sf):
    from poolwise.operators.prep import melt_outcomes
    from poolwise.sources.tables import read_table
    facts = read_table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("status"), fx.disc_level().alias("disc"), fx.tax_level().alias("tax"),
        fx.outcome().alias("quantity"), (F.col("l_extendedprice") / 10000).alias("price"))
    long = melt_outcomes(facts, ["status", "disc", "tax"], ["quantity", "price"])
    cells = C.cell_moments(fx.TREAT, long, by=["outcome"]).withColumnRenamed("mean_y", "beta")
    return rounded(T.effect_table(fx.TREAT, cells, "status", "outcome", ["quantity", "price"]))


# ---- posterior ---------------------------------------------------------------------------------

_W = f"""{KEPT}, best as (select min(q) q0 from kept), weighted as (select k.*, exp(q0 - q) / sum(exp(q0 - q)) over () w from kept k, best),
    beta as (select a.policy_id, sum(w * p.mean_y) / sum(w) beta from weighted join assigned a using (cut_mask) join pooled p using (cut_mask, pool_id) group by 1)"""


def _weighted(spark, sf, cells=None):
    return materialize(B.weights(kept(spark, sf, cells)), "weighted")


def _boxes(spark, sf, cells):
    return materialize(P.box_moments(fx.SINGLE, cells), "boxes")


def _beta(spark, sf, cells=None):
    cells = cells if cells is not None else single_cells(spark, sf)
    boxes = P.box_moments(fx.SINGLE, cells)
    effects = B.posterior_effects(fx.SINGLE, _weighted(spark, sf, cells), boxes)
    return effects.join(cells.select("policy_id"), "policy_id", "left_semi")


@query("post_weights", f"with {_W} select cut_mask, round(w, 9) weight from weighted")
def post_weights(spark, sf):
    return _weighted(spark, sf).select("cut_mask", F.round("weight", 9).alias("weight"))


@query("post_ratios", f"""with {_W} select cut_mask, round(w / max(w) over (), 9) to_map, round((w - max(w) over ()) / max(w) over (), 9) + 0.0 gap,
    round((w - min(w) over ()) / (max(w) over () - min(w) over ()), 6) scaled from weighted""")
def post_ratios(spark, sf):
    df = B.ratios(_weighted(spark, sf))
    return df.select("cut_mask", F.round("to_map", 9).alias("to_map"), (F.round("gap", 9) + 0.0).alias("gap"), F.round("scaled", 6).alias("scaled"))


@query("post_effects", f"with {_W} select policy_id, round(beta, 9) beta from beta")
def post_effects(spark, sf):
    return _beta(spark, sf).select("policy_id", F.round("beta", 9).alias("beta"))


@query("post_effects_models", f"""with {MODELS}, parts_of as (select model_key, exp(0.02 - loss) w, cast(split_part(x, ':', 1) as int) profile_id, cast(split_part(x, ':', 2) as bigint) cut_mask
        from (select model_key, loss, unnest(string_split(model_key, '|')) x from models))
    select a.policy_id, round(sum(w * p.mean_y) / sum(w), 9) beta from parts_of join assigned a using (profile_id, cut_mask) join pooled p using (profile_id, cut_mask, pool_id) group by 1""")
def post_effects_models(spark, sf):
    """Over models of many profiles; the weights meet each partition once."""
    cells = multi_cells(spark, sf)
    models = materialize(M.near_optimal_models(fx.MULTI, cells, THETA_M, REG_M), "models")
    weighted = B.weights(models, "loss")
    members = weighted.select("weight", F.explode("members").alias("_m")).select("weight", "_m.*")
    effects = B.posterior_effects(fx.MULTI, B.partition_weights(members), P.box_moments(fx.MULTI, cells))
    return effects.join(cells.select("policy_id"), "policy_id", "left_semi").select("policy_id", F.round("beta", 9).alias("beta"))


@query("post_top_cells", f"""with {_W}, b as (select policy_id, round(beta, 9) beta from beta)
    select * from (select policy_id, beta, true is_top from b order by beta desc, policy_id limit 10) union all
    select * from (select policy_id, beta, false from b order by beta, policy_id limit 10)""")
def post_top_cells(spark, sf):
    beta = materialize(_beta(spark, sf).select("policy_id", F.round("beta", 9).alias("beta")), "beta")
    return B.top_cells(beta, 10).withColumn("is_top", F.lit(True)).unionByName(B.top_cells(beta, 10, best=False).withColumn("is_top", F.lit(False)))


@query("post_effect_error", f"""with {_W}, everything as (select s.cut_mask, exp(q0 - q) w from scored s, best),
    full_beta as (select a.policy_id, sum(w * p.mean_y) / sum(w) beta from everything join assigned a using (cut_mask) join pooled p using (cut_mask, pool_id) group by 1)
    select round(sqrt((select sum((b.beta - f.beta) * (b.beta - f.beta)) from beta b join full_beta f using (policy_id))), 7) error_full,
        round(sqrt((select sum((b.beta - c.mean_y) * (b.beta - c.mean_y)) from beta b join cells c using (policy_id))), 7) error_cells,
        15 in (select cut_mask from kept) found""")
def post_effect_error(spark, sf):
    """Set against full posterior, set against the cell means, and whether the set holds the partition that only splits the quantity."""
    cells = single_cells(spark, sf)
    boxes = materialize(P.box_moments(fx.SINGLE, cells), "boxes")
    everything = B.weights(materialize(P.score_partitions(fx.SINGLE, P.enumerate_partitions(spark, fx.SINGLE, FULL), cells, REG, boxes=boxes), "scored"))
    full = B.posterior_effects(fx.SINGLE, everything, boxes).join(cells.select("policy_id"), "policy_id", "left_semi")
    beta = materialize(_beta(spark, sf, cells), "beta")
    truth = cells.select("policy_id", F.col("mean_y").alias("beta"))
    sets = kept(spark, sf, cells)
    return (B.effect_error(beta, full).select(F.round("l2_error", 7).alias("error_full"))
            .withColumn("error_cells", B.effect_error(beta, truth).select(F.round("l2_error", 7)).scalar())
            .withColumn("found", B.contains_partition(sets, FULL, 15).scalar()))


_POSITIONS = ", ".join(f"('{n}', {j}, {fx.SINGLE.offsets[i] + j})" for i, n in enumerate(fx.SINGLE.names) for j in range(fx.SINGLE.bits[i]))


@query("post_split_frequency", f"""with {KEPT} select factor, position, round(avg((cut_mask >> b) & 1), 9) share from kept, (values {_POSITIONS}) t(factor, position, b) group by factor, position""")
def post_split_frequency(spark, sf):
    return rounded(B.split_frequency(fx.SINGLE, kept(spark, sf)), 9)


@query("post_split_frequency_weighted", f"""with {_W} select factor, position, round(sum(w * ((cut_mask >> b) & 1)) / sum(w), 9) share from weighted, (values {_POSITIONS}) t(factor, position, b) group by factor, position""")
def post_split_frequency_weighted(spark, sf):
    cells = single_cells(spark, sf)
    return rounded(B.split_frequency(fx.SINGLE, _weighted(spark, sf, cells), weight=F.col("weight")), 9)


@query("post_factor_pooled", f"""with {KEPT} select factor, round(avg(case when ((cut_mask >> o) & f) <> f then 1.0 else 0.0 end), 9) share
    from kept, (values {', '.join(f"('{n}', {fx.SINGLE.offsets[i]}, {fx.SINGLE.full_mask(i)})" for i, n in enumerate(fx.SINGLE.names))}) t(factor, o, f) group by factor""")
def post_factor_pooled(spark, sf):
    return rounded(B.factor_pooled_frequency(fx.SINGLE, kept(spark, sf)), 9)


_VS_BASE = f"""{_W}, fitted as (select k.cut_mask, k.w, c.qty, c.disc, c.tax, c.flag, p.pool_id, p.mean_y from weighted k join assigned a using (cut_mask)
        join pooled p using (cut_mask, pool_id) join cells c on c.policy_id = a.policy_id),
    vs as ({' union all '.join(f"select a.cut_mask, a.w, '{n}' factor, a.{n} lev, case when a.pool_id = b.pool_id then 0.0 else a.mean_y - b.mean_y end effect from fitted a join fitted b on a.cut_mask = b.cut_mask and b.{n} = 1 and a.{n} > 1 and " + ' and '.join(f'a.{o} = b.{o}' for o in fx.SINGLE.names if o != n) for n in fx.SINGLE.names)}),
    sig as (select factor, stddev_pop(effect) sigma from vs group by 1),
    binned as (select vs.*, case when effect = 0 then 2 when effect >= 2 * sigma then 0 when effect > 0 then 1 when effect >= -2 * sigma then 3 else 4 end bin from vs join sig using (factor))"""


def _effects(spark, sf):
    cells = single_cells(spark, sf)
    return materialize(B.effects_vs_base(fx.SINGLE, _weighted(spark, sf, cells), _boxes(spark, sf, cells), keep=["weight"]), "effects")


@query("post_effects_vs_base", f"""with {_VS_BASE} select cut_mask, factor, lev as level, count(*) n_cells, round(sum(effect), 6) + 0.0 total, round(max(effect), 9) + 0.0 top from vs group by cut_mask, factor, lev""")
def post_effects_vs_base(spark, sf):
    return (_effects(spark, sf).groupBy("cut_mask", "factor", "level")
            .agg(F.sum("n_cells").alias("n_cells"), (F.round(F.sum(F.col("effect") * F.col("n_cells")), 6) + 0.0).alias("total"),
                 (F.round(F.max("effect"), 9) + 0.0).alias("top")))


@query("post_sigma_bins", f"""with {_VS_BASE} select factor, bin, count(*) n_cells, round(any_value(sigma), 9) sigma from binned join sig using (factor) group by factor, bin""")
def post_sigma_bins(spark, sf):
    effects = _effects(spark, sf)
    sigma = B.spread_of(effects, ["factor"])
    binned = effects.join(sigma, "factor").withColumn("bin", B.sigma_bin(F.col("effect"), F.col("sigma")))
    return binned.groupBy("factor", "bin").agg(F.sum("n_cells").alias("n_cells"), F.round(F.max("sigma"), 9).alias("sigma"))


@query("post_effect_histogram", f"""with {_VS_BASE} select factor, lev as level, {', '.join(f'round(sum(case when bin = {b} then w else 0.0 end) / sum(w), 9) bin_{b}' for b in range(5))} from binned group by factor, lev""")
def post_effect_histogram(spark, sf):
    return rounded(B.effect_histogram(_effects(spark, sf), ["factor", "level"], ["factor"]), 9)


@query("post_effect_histogram_3", f"""with {_VS_BASE} select factor, round(sum(case when effect > 0 then w else 0.0 end) / sum(w), 9) bin_0,
    round(sum(case when effect = 0 then w else 0.0 end) / sum(w), 9) bin_1, round(sum(case when effect < 0 then w else 0.0 end) / sum(w), 9) bin_2 from binned group by factor""")
def post_effect_histogram_3(spark, sf):
    return rounded(B.effect_histogram(_effects(spark, sf), ["factor"], ["factor"], bins=3), 9)


@query("post_sign_shares", f"""with {_VS_BASE} select factor, round(avg(case when effect > 0 then 1.0 else 0.0 end), 9) positive, round(avg(case when effect = 0 then 1.0 else 0.0 end), 9) zero,
    round(avg(case when effect < 0 then 1.0 else 0.0 end), 9) negative from vs group by factor""")
def post_sign_shares(spark, sf):
    return rounded(B.sign_shares(_effects(spark, sf), ["factor"]), 9)


_BINNED = "cast(case when hi > lo then least(floor((q - lo) / (hi - lo) * 12), 11) else 0 end as int)"


@query("post_loss_histogram", f"with {SINGLE}, r as (select min(q) lo, max(q) hi from scored) select {_BINNED} bin, count(*) n_models from scored, r group by 1")
def post_loss_histogram(spark, sf):
    scored = P.score_partitions(fx.SINGLE, P.enumerate_partitions(spark, fx.SINGLE, FULL), single_cells(spark, sf), REG)
    return B.loss_histogram(materialize(scored, "scored"), 12)


@query("post_size_histogram", f"with {_W} select h, count(*) n_models, round(sum(w), 9) weight from weighted group by h")
def post_size_histogram(spark, sf):
    return rounded(B.size_histogram(_weighted(spark, sf)), 9)


@query("post_size_weight_histogram", f"""with {SINGLE}, e as (select h, exp(-q) w from scored), r as (select min(w) lo, max(w) hi from e)
    select h, cast(least(floor((w - lo) / (hi - lo) * 5), 4) as int) bin, count(*) n_models from e, r group by 1, 2""")
def post_size_weight_histogram(spark, sf):
    scored = P.score_partitions(fx.SINGLE, P.enumerate_partitions(spark, fx.SINGLE, FULL), single_cells(spark, sf), REG)
    return B.size_weight_histogram(materialize(B.weights(materialize(scored, "scored")), "weighted"), 5)


@query("post_approximation_error", f"""with {SINGLE}, b as (select min(q) q0 from scored), w as (select cut_mask, q, exp(q0 - q) / sum(exp(q0 - q)) over () p, q / q0 - 1 eps,
        row_number() over (order by round(q, 12), cut_mask) k from scored, b)
    select cut_mask, k rps_size, round(p, 9) weight, round(eps, 7) epsilon, round(2 * (1 - p * k), 7) error, round(2 * p * (2048 - k), 7) error2,
        round(least(2 * (1 - p * k), 2 * p * (2048 - k), 1.0), 7) error_best from w""".replace("rps_size", "set_size"))
def post_approximation_error(spark, sf):
    scored = P.score_partitions(fx.SINGLE, P.enumerate_partitions(spark, fx.SINGLE, FULL), single_cells(spark, sf), REG)
    df = B.approximation_error(materialize(scored, "scored"), 2**fx.SINGLE.total_bits)
    return df.select("cut_mask", "set_size", F.round("weight", 9).alias("weight"), *[F.round(c, 7).alias(c) for c in ("epsilon", "error", "error2", "error_best")])


@query("post_cumulative_mass", f"""with {_W}, o as (select cut_mask, w, sum(w) over (order by round(q, 12), cut_mask) cum, row_number() over (order by round(q, 12), cut_mask) position from weighted)
    select cut_mask, position, round(cum, 9) cum_mass, round(w / cum, 9) ratio, round(w / cum - lag(w / cum) over (order by position), 9) ratio_step from o""")
def post_cumulative_mass(spark, sf):
    df = B.cumulative_mass(kept(spark, sf))
    return df.select("cut_mask", "position", *[F.round(c, 9).alias(c) for c in ("cum_mass", "ratio", "ratio_step")])


@query("post_category_summary", f"""with {_W} select case when c.qty <= 2 then 'small' else 'large' end category, c.flag, count(*) n_cells, round(avg(beta), 7) mean_effect,
    round(min(beta), 7) min_effect, round(quantile_cont(beta, 0.5), 7) median_effect, round(max(beta), 7) max_effect from beta join cells c using (policy_id) group by 1, 2""")
def post_category_summary(spark, sf):
    effects = _beta(spark, sf).select("policy_id", "beta", fx.SINGLE.level(0).alias("qty"), fx.SINGLE.level(3).alias("flag"))
    return rounded(B.category_summary(effects, F.when(F.col("qty") <= 2, "small").otherwise("large"), ["flag"]).drop("quantiles"), 7)


@query("post_category_quantiles", f"""with {_W} select case when c.qty <= 2 then 'small' else 'large' end category, {', '.join(f'round(quantile_cont(beta, {p}), 7) q{int(p * 100)}' for p in (0.05, 0.25, 0.75, 0.95))}
    from beta join cells c using (policy_id) group by 1""")
def post_category_quantiles(spark, sf):
    """Outer and inner quantiles of the effects per category."""
    effects = _beta(spark, sf).select("policy_id", "beta", fx.SINGLE.level(0).alias("qty"))
    shares = (0.05, 0.25, 0.75, 0.95)
    df = B.category_summary(effects, F.when(F.col("qty") <= 2, "small").otherwise("large"), shares=shares)
    return df.select("category", *[F.round(F.get("quantiles", F.lit(i)), 7).alias(f"q{int(p * 100)}") for i, p in enumerate(shares)])


# ---- metrics -----------------------------------------------------------------------------------

_TRUTH = "truth as (select policy_id, qty, disc, tax, flag, qty + disc + tax + flag dosage, n, mean_y, round(mean_y, 1) effect from cells), true_best as (select * from truth where effect = (select max(effect) from truth))"


def _truth(cells):
    return cells.select("policy_id", *fx.SINGLE.level_columns(), "n", "mean_y", F.round("mean_y", 1).alias("effect"))


@query("metric_mse", f"with {_W} select round(avg((y - beta) * (y - beta)), 9) mse from obs join cells using (qty, disc, tax, flag) join beta using (policy_id)".replace("(y - beta)", "(obs.y - beta)"))
def metric_mse(spark, sf):
    rows = fx.lineitem_single(spark, sf).withColumn("policy_id", fx.SINGLE.policy_id()).join(F.broadcast(_beta(spark, sf)), "policy_id")
    return rounded(X.mean_squared_error(rows, "y", "beta"), 9)


@query("metric_best_policies", f"with {S.cells(fx.SINGLE, 'single')}, {_TRUTH} select policy_id, effect, n from true_best")
def metric_best_policies(spark, sf):
    return X.best_policies(_truth(single_cells(spark, sf)), "effect").select("policy_id", "effect", "n")


_BETA_BEST = "beta_best as (select policy_id from beta where round(beta, 1) = (select max(round(beta, 1)) from beta))"


@query("metric_iou", f"""with {_W}, {_TRUTH}, {_BETA_BEST} select round((select count(*) from true_best where policy_id in (select policy_id from beta_best)) * 1.0 /
    (select count(*) from (select policy_id from true_best union select policy_id from beta_best)), 9) iou""")
def metric_iou(spark, sf):
    cells = single_cells(spark, sf)
    truth = X.best_policies(_truth(cells), "effect")
    mine = X.best_policies(_beta(spark, sf, cells), "beta", digits=1)
    return rounded(X.intersection_over_union(truth, mine), 9)


@query("metric_min_dosage", f"with {S.cells(fx.SINGLE, 'single')}, {_TRUTH} select policy_id, cast(dosage as bigint) dosage from true_best where dosage = (select min(dosage) from true_best)")
def metric_min_dosage(spark, sf):
    best = X.best_policies(_truth(single_cells(spark, sf)), "effect")
    return X.min_dosage(best, list(fx.SINGLE.names)).select("policy_id", "dosage")


@query("metric_membership", f"with {_W}, {_TRUTH}, {_BETA_BEST} select count(*) > 0 shares_member from true_best join beta_best using (policy_id) where dosage = (select min(dosage) from true_best)")
def metric_membership(spark, sf):
    cells = single_cells(spark, sf)
    low = X.min_dosage(X.best_policies(_truth(cells), "effect"), list(fx.SINGLE.names))
    return X.shares_member(low, X.best_policies(_beta(spark, sf, cells), "beta", digits=1))


@query("metric_best_gap", f"with {_W} select round((select max(mean_y) from cells), 7) best_true, round((select max(beta) from beta), 7) best_estimate, round((select max(mean_y) from cells) - (select max(beta) from beta), 7) gap")
def metric_best_gap(spark, sf):
    cells = single_cells(spark, sf)
    return rounded(X.best_effect_gap(cells, materialize(_beta(spark, sf, cells), "beta"), "mean_y", "beta"), 7)


@query("metric_profile_indicator", f"""with {S.cells(fx.MULTI, 'multi')}, best as (select * from cells where round(mean_y, 1) = (select max(round(mean_y, 1)) from cells))
    select {', '.join(f'cast(max(case when profile_id = {p} then 1 else 0 end) as int) profile_{p}' for p in range(8))} from best""")
def metric_profile_indicator(spark, sf):
    best = X.best_policies(multi_cells(spark, sf).select("policy_id", "mean_y"), "mean_y", digits=1)
    return X.profile_indicator(fx.MULTI, best)


@query("metric_models", f"""with {KEPT}, {_TRUTH}, low as (select policy_id from true_best where dosage = (select min(dosage) from true_best)),
    tops as (select cut_mask, max(round(mean_y, 9)) r, max(mean_y) m from pooled where cut_mask in (select cut_mask from kept) group by 1),
    est as (select a.cut_mask, a.policy_id, t.m from assigned a join pooled p using (cut_mask, pool_id) join tops t on t.cut_mask = a.cut_mask and round(p.mean_y, 9) = t.r)
    select k.cut_mask, k.h, round(k.sse / (select sum(n) from cells), 9) mse,
        round(count(b.policy_id) * 1.0 / (count(*) + (select count(*) from true_best) - count(b.policy_id)), 9) iou,
        bool_or(e.policy_id in (select policy_id from low)) min_dosage_hit, round((select max(mean_y) from cells) - any_value(e.m), 7) best_gap
    from kept k join est e using (cut_mask) left join true_best b using (policy_id) group by k.cut_mask, k.h, k.sse""")
def metric_models(spark, sf):
    cells = single_cells(spark, sf)
    best = materialize(X.best_policies(_truth(cells), "effect"), "best")
    low = X.min_dosage(best, list(fx.SINGLE.names))
    boxes = P.box_moments(fx.SINGLE, cells)
    top = float(scalar(cells.agg(F.max("mean_y"))))
    df = X.partition_metrics(fx.SINGLE, kept(spark, sf, cells), boxes, cells, best, low, top)
    return df.select("cut_mask", "h", F.round("mse", 9).alias("mse"), F.round("iou", 9).alias("iou"), "min_dosage_hit", F.round("best_gap", 7).alias("best_gap"))


# models over all profiles: cells of their best pools
_MODEL_BEST = f"""{MODELS}, members as (select model_key, n_pools, cast(split_part(x, ':', 1) as int) profile_id, cast(split_part(x, ':', 2) as bigint) cut_mask
        from (select model_key, n_pools, unnest(string_split(model_key, '|')) x from models)),
    est as (select m.model_key, m.n_pools, a.profile_id, a.policy_id, p.mean_y m, round(p.mean_y, 9) r from members m join assigned a using (profile_id, cut_mask) join pooled p using (profile_id, cut_mask, pool_id)),
    tops as (select model_key, max(r) r from est group by 1), best as (select e.* from est e join tops t on t.model_key = e.model_key and t.r = e.r),
    true_best as (select policy_id, qty + disc + tax dosage from cells where round(mean_y, 1) = (select max(round(mean_y, 1)) from cells)),
    errors as (select model_key, sum(sse) / (select sum(n) from cells) mse from members join scored using (profile_id, cut_mask) group by 1)"""


def _model_metrics(spark, sf):
    cells = multi_cells(spark, sf)
    sets = materialize(M.profile_sets(fx.MULTI, cells, THETA_M, REG_M), "sets")
    models = materialize(M.near_optimal_models(fx.MULTI, cells, THETA_M, REG_M, sets=sets), "models")
    truth = cells.select("policy_id", *fx.MULTI.level_columns(), F.round("mean_y", 1).alias("effect"))
    best = materialize(X.best_policies(truth, "effect"), "best")
    low = X.min_dosage(best, list(fx.MULTI.names))
    return X.model_metrics(fx.MULTI, models, sets, P.box_moments(fx.MULTI, cells), cells, best, low, float(scalar(cells.agg(F.max("mean_y")))))


@query("metric_models_profiles", f"""with {_MODEL_BEST} select b.model_key, any_value(b.n_pools) n_pools, round(any_value(e.mse), 9) mse,
        round(count(t.policy_id) * 1.0 / (count(*) + (select count(*) from true_best) - count(t.policy_id)), 9) iou,
        coalesce(bool_or(t.dosage = (select min(dosage) from true_best)), false) min_dosage_hit, round((select max(mean_y) from cells) - max(b.m), 7) best_gap
    from best b join errors e using (model_key) left join true_best t using (policy_id) group by b.model_key""")
def metric_models_profiles(spark, sf):
    """All metrics of every model over all profiles."""
    scored, _ = _model_metrics(spark, sf)
    return scored.select("model_key", "n_pools", F.round("mse", 9).alias("mse"), F.round("iou", 9).alias("iou"), "min_dosage_hit", F.round("best_gap", 7).alias("best_gap"))


@query("metric_model_profile_indicator", f"with {_MODEL_BEST} select distinct model_key, profile_id from best")
def metric_model_profile_indicator(spark, sf):
    """Profiles in which each model has its best cells."""
    return _model_metrics(spark, sf)[1]


@query("metric_profile_indicator_long", f"""with {S.cells(fx.MULTI, 'multi')}, tops as (select disc, max(round(mean_y, 1)) m from cells group by 1)
    select distinct cast(disc as int) disc, profile_id from cells join tops using (disc) where round(mean_y, 1) = m""")
def metric_profile_indicator_long(spark, sf):
    """Profiles of the best cells of each discount band."""
    cells = multi_cells(spark, sf).select("policy_id", fx.MULTI.level(1).alias("disc"), "mean_y")
    return X.profiles_of(fx.MULTI, X.best_policies(cells, "mean_y", digits=1, by=["disc"]), ["disc"])


_TE = f"""{_EFFECTS}, pick as (select mask_t, mask_c from pairs order by round(sse, 6) + {REG_T} * h * 60000, mask_t, mask_c limit 1),
    raw as (select c.policy_id control_id, t.mean_y - c.mean_y te_true from cells c join cells t on c.profile_id = 3 and t.profile_id = 7 and c.disc = t.disc and c.tax = t.tax),
    both_te as (select control_id, te_true, avg(effect) te_est from raw join effects using (control_id) group by all)"""


def _te_table(spark, sf):
    """Per matched cell: difference of cell means, and the mean estimate over the pairs of the set."""
    cells, members, _, boxes = _treat(spark, sf)
    found = T.effects_by_cell(fx.TREAT, T.pair_effects(fx.TREAT, T.partition_pairs(fx.TREAT, members, "status"), boxes, "status"))
    est = found.groupBy("control_id").agg(F.avg("effect").alias("te_est"))
    side = lambda k, m: cells.select(F.col("policy_id").alias(k), F.col("mean_y").alias(m))
    pairs = T.matched_cells(fx.TREAT, cells.select("policy_id"), "status")
    truth = (pairs.join(side("control_id", "c"), "control_id").join(side("treated_id", "t"), "treated_id")
             .select("control_id", (F.col("t") - F.col("c")).alias("te_true")))
    return materialize(truth.join(est, "control_id"), "te")


@query("metric_treatment", f"""with {_TE}, m as (select *, max(round(te_true, 9)) over () mt, max(round(te_est, 9)) over () me from both_te)
    select round(avg((te_true - te_est) * (te_true - te_est)), 9) mse_te, round(max(te_true) - max(te_est), 7) max_te_err,
        round(count(*) filter (round(te_true, 9) = mt and round(te_est, 9) = me) * 1.0 / count(*) filter (round(te_true, 9) = mt or round(te_est, 9) = me), 9) iou from m""")
def metric_treatment(spark, sf):
    df = X.treatment_effect_metrics(_te_table(spark, sf), "control_id", "te_true", "te_est")
    return df.select(F.round("mse_te", 9).alias("mse_te"), F.round("max_te_err", 7).alias("max_te_err"), F.round("iou", 9).alias("iou"))


@query("metric_sign_confusion", f"""with {_TE}, g as (select a.t true_sign, b.e est_sign from (values (-1), (0), (1)) a(t), (values (-1), (0), (1)) b(e)),
    c as (select cast(sign(te_true) as int) true_sign, cast(sign(te_est) as int) est_sign, count(*) n from both_te group by 1, 2)
    select true_sign, est_sign, round(coalesce(n * 1.0 / sum(n) over (partition by true_sign), 0.0), 9) share from g left join c using (true_sign, est_sign)""")
def metric_sign_confusion(spark, sf):
    return rounded(X.sign_confusion(_te_table(spark, sf), "te_true", "te_est"), 9)
