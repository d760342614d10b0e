"""Queries: sources, preparation, design and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwise.operators import cells as C, design as D, prep as P
from poolwise.plans import fixtures as fx, sql as S
from poolwise.plans.registry import query, rounded
from poolwise.runtime import materialize, scratch_path
from poolwise.sources import tables as T

# ---- sources and sinks -------------------------------------------------------------------


@query("source_csv_roundtrip", """
    select c_mktsegment, count(*) n, round(sum(c_acctbal), 2) balance, cast(max(c_custkey) as bigint) last_key
    from customer group by c_mktsegment""")
def source_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    T.write_csv(T.read_table(spark, sf, "customer"), path, index_column="row_index")
    df = T.read_csv(spark, path, "row_index long, c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                    index_column="row_index")
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"),
                                          F.max("c_custkey").alias("last_key"))


@query("source_result_folder", """
    select event_type, count(*) n, round(avg(value), 6) mean_value, true from_files from events group by event_type""")
def source_result_folder(spark, sf):
    path = scratch_path(spark, "results")
    events = T.read_table(spark, sf, "events").select("event_id", "event_type", "value")
    events.repartition(4, "event_id").write.option("header", True).csv(path)
    df = T.read_results(spark, path, "event_id long, event_type string, value double")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"),
                                        F.bool_and(F.col("source_file").endswith(".csv")).alias("from_files"))


_SINGLE_SCORES = S.scores(fx.SINGLE, "single", 1e-4, 15)


@query("source_model_set", f"""with {_SINGLE_SCORES}
    select 'quantity' outcome, 'base' config, cut_mask, h, round(q, 9) q, cast(0.0055 as double) theta from scored where q <= 0.0055""")
def source_model_set(spark, sf):
    from poolwise.operators.search import exhaustive_set
    cells = C.cell_table(fx.SINGLE, fx.lineitem_single(spark, sf))
    found = materialize(exhaustive_set(fx.SINGLE, cells, 0.0055, 1e-4, fx.SINGLE.full_profile), "found")
    path = scratch_path(spark, "modelset")
    models = found.select(F.col("cut_mask").cast("string").alias("model_key"), F.col("q").alias("loss"))
    T.save_model_set(path, "quantity", "base", found, models, {"theta": 0.0055, "reg": 1e-4})
    saved = T.load_model_set(spark, path, "quantity", "base")
    return (saved["partitions"].join(saved["parameters"], ["outcome", "config"])
            .select("outcome", "config", "cut_mask", "h", F.round("q", 9).alias("q"), "theta"))


@query("source_resume_sweep", """
    select l_returnflag, l_linestatus, count(*) n, round(avg(l_quantity), 6) mean_qty, l_returnflag <> 'A' was_pending
    from lineitem group by l_returnflag, l_linestatus""")
def source_resume_sweep(spark, sf):
    keys = ["l_returnflag", "l_linestatus"]
    path = scratch_path(spark, "sweep")
    facts = T.read_table(spark, sf, "lineitem").select(*keys, "l_quantity")
    todo = facts.select(*keys).distinct()
    run = lambda settings, flag: (facts.join(settings, keys, "left_semi").groupBy(*keys)
                                  .agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_qty"))
                                  .withColumn("was_pending", F.lit(flag)))
    T.write_sweep(run(todo.where("l_returnflag = 'A'"), False), path, keys)
    T.write_sweep(run(T.pending(todo, spark.read.parquet(path), keys), True), path, keys)
    return spark.read.parquet(path).select(*keys, "n", "mean_qty", "was_pending")


# ---- preparation ----------------------------------------------------------------------------


@query("prep_project_union", """
    select cohort, nation, count(*) n, round(sum(balance), 2) balance, count(segment) with_segment from (
        select 'customer' cohort, c_nationkey nation, c_acctbal balance, c_mktsegment segment from customer
        union all select 'supplier', s_nationkey, s_acctbal, null from supplier) group by cohort, nation""")
def prep_project_union(spark, sf):
    a = P.project(T.read_table(spark, sf, "customer"), {"c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"})
    b = P.project(T.read_table(spark, sf, "supplier"), {"s_nationkey": "nation", "s_acctbal": "balance"})
    both = P.union_cohorts(a.withColumn("cohort", F.lit("customer")), b.withColumn("cohort", F.lit("supplier")))
    return both.groupBy("cohort", "nation").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"),
                                                F.count("segment").alias("with_segment"))


@query("prep_first_non_null", """
    select l_returnflag, round(sum(coalesce(nullif(l_tax, 0.08), nullif(l_discount, 0.05), -1.0)), 4) total
    from lineitem group by l_returnflag""")
def prep_first_non_null(spark, sf):
    df = T.read_table(spark, sf, "lineitem").select(
        "l_returnflag", P.first_present(F.nullif("l_tax", F.lit(0.08)), F.nullif("l_discount", F.lit(0.05)), F.lit(-1.0)).alias("v"))
    return df.groupBy("l_returnflag").agg(F.round(F.sum("v"), 4).alias("total"))


@query("prep_recode", """
    with t as (select nullif(o_orderpriority, '3-MEDIUM') p, o_orderstatus s from orders)
    select case when p is null then 'unknown' when p = '1-URGENT' then 'high' when p = '2-HIGH' then 'high' when p = '5-LOW' then 'low'
        else 'other' end label, case s when 'F' then 1 when 'O' then 2 end level, count(*) n from t group by 1, 2""")
def prep_recode(spark, sf):
    df = T.read_table(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("p"), F.col("o_orderstatus").alias("s"))
    label = P.recode("p", {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}, default="other", null_label="unknown")
    return df.groupBy(label.alias("label"), P.recode("s", {"F": 1, "O": 2}).alias("level")).agg(F.count("*").alias("n"))


@query("prep_recode_by_table", """
    select n_name, count(*) n from customer left join nation on c_nationkey = n_nationkey group by n_name""")
def prep_recode_by_table(spark, sf):
    labels = T.read_table(spark, sf, "nation")
    df = P.recode_by_table(T.read_table(spark, sf, "customer"), "c_nationkey", labels, "n_nationkey", "n_name", "n_name")
    return df.groupBy("n_name").agg(F.count("*").alias("n"))


@query("prep_band", """
    select case when p_size is null then null when p_size <= 10 then '<=10' when p_size <= 25 then '<=25' when p_size <= 40 then '<=40' else '>40' end size_band,
        count(*) n, round(avg(p_retailprice), 6) mean_price
    from (select nullif(p_size, 7) p_size, p_retailprice from part) group by 1""")
def prep_band(spark, sf):
    df = T.read_table(spark, sf, "part").select(F.nullif("p_size", F.lit(7)).alias("p_size"), "p_retailprice")
    return (df.groupBy(P.band("p_size", [10, 25, 40], ["<=10", "<=25", "<=40", ">40"]).alias("size_band"))
            .agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price")))


@query("prep_level_groups", """
    select case when l_linenumber in (1) then 0 when l_linenumber in (2, 3) then 1 when l_linenumber in (4, 5) then 2 when l_linenumber in (6, 7) then 3 end line_level,
        least(l_linenumber, 3) capped, count(*) n from lineitem group by 1, 2""")
def prep_level_groups(spark, sf):
    df = T.read_table(spark, sf, "lineitem")
    return (df.groupBy(P.group_levels("l_linenumber", {0: [1], 1: [2, 3], 2: [4, 5], 3: [6, 7]}).alias("line_level"),
                       P.cap("l_linenumber", 3).alias("capped")).agg(F.count("*").alias("n")))


@query("prep_quantile_cut", """
    with t as (select nullif(c_acctbal, 0.0) v, c_mktsegment from customer),
    e as (select quantile_cont(v, 0.25) a, quantile_cont(v, 0.5) b, quantile_cont(v, 0.75) c from t)
    select c_mktsegment, case when v is null then null when v <= a then 0 when v <= b then 1 when v <= c then 2 else 3 end quartile,
        count(*) n, round(sum(v), 2) total from t, e group by 1, 2""")
def prep_quantile_cut(spark, sf):
    df = T.read_table(spark, sf, "customer").select(F.nullif("c_acctbal", F.lit(0.0)).alias("v"), "c_mktsegment")
    return (P.quantile_cut(df, "v", 4, "quartile").groupBy("c_mktsegment", "quartile")
            .agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total")))


@query("prep_row_ops", """
    with t as (select l_returnflag, nullif(l_tax, 0.08) a, nullif(l_discount, 0.1) b, nullif(l_linenumber, 7) k from lineitem)
    select l_returnflag, round(sum(greatest(a, b)), 4) top, round(sum(case when a is null then b when b is null then a else (a + b) / 2 end), 4) middle,
        cast(sum(coalesce(k, 0)) as bigint) filled from t group by l_returnflag""")
def prep_row_ops(spark, sf):
    df = T.read_table(spark, sf, "lineitem").select("l_returnflag", F.nullif("l_tax", F.lit(0.08)).alias("a"),
                                                    F.nullif("l_discount", F.lit(0.1)).alias("b"), F.nullif("l_linenumber", F.lit(7)).alias("k"))
    df = P.fill_defaults(df.select("*", P.row_max("a", "b").alias("top"), P.row_mean("a", "b").alias("middle")), {"k": 0})
    return df.groupBy("l_returnflag").agg(F.round(F.sum("top"), 4).alias("top"), F.round(F.sum("middle"), 4).alias("middle"),
                                          F.sum("k").alias("filled"))


@query("prep_left_join", """
    with t as (select o_orderkey k, o_totalprice total from orders where o_orderstatus <> 'P'),
    l as (select l_orderkey k, l_extendedprice total from lineitem)
    select count(*) n, count(t.total) matched, round(sum(l.total), 2) line_total, round(sum(t.total), 2) order_total
    from l left join t on l.k = t.k""")
def prep_left_join(spark, sf):
    o = T.read_table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    l = T.read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("total"))
    j = P.left_join(l, o, ["k"], ("_line", "_order"))
    return j.agg(F.count("*").alias("n"), F.count("total_order").alias("matched"), F.round(F.sum("total_line"), 2).alias("line_total"),
                 F.round(F.sum("total_order"), 2).alias("order_total"))


@query("prep_complete_cases", """
    select l_returnflag, count(*) n, round(sum(l_extendedprice), 2) total from lineitem
    where l_tax <> 0.08 and l_discount <> 0.1 and l_extendedprice <= 90000 and l_linenumber not in (6) group by l_returnflag""")
def prep_complete_cases(spark, sf):
    df = T.read_table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice", F.nullif("l_tax", F.lit(0.08)).alias("tax"),
                                                    F.nullif("l_discount", F.lit(0.1)).alias("discount"))
    df = P.without_keys(P.without_outliers(P.complete_cases(df, ["tax", "discount"]), "l_extendedprice", high=90000), "l_linenumber", [6])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("prep_min_max", """
    with t as (select o_orderstatus, (o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()) s,
        (o_totalprice - min(o_totalprice) over (partition by o_orderstatus)) / (max(o_totalprice) over (partition by o_orderstatus) - min(o_totalprice) over (partition by o_orderstatus)) g
        from orders)
    select o_orderstatus, round(avg(s), 6) scaled, round(avg(g), 6) scaled_in_group from t group by 1""")
def prep_min_max(spark, sf):
    df = T.read_table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    df = P.min_max_scale(P.min_max_scale(df, "o_totalprice", "s"), "o_totalprice", "g", ["o_orderstatus"])
    return df.groupBy("o_orderstatus").agg(F.round(F.avg("s"), 6).alias("scaled"), F.round(F.avg("g"), 6).alias("scaled_in_group"))


@query("prep_shift_levels", f"""
    with obs as ({S.OBS['multi']}), shifted as (select qty + 1 qty, disc, tax + 1 tax, y from obs)
    select cast(qty * 20 + disc * 5 + tax as bigint) shifted_id, count(*) n from
        (select qty, disc, tax from shifted) group by 1""")
def prep_shift_levels(spark, sf):
    df, spec = P.shift_levels(fx.lineitem_multi(spark, sf), fx.MULTI, ["qty", "tax"])
    assert spec.levels == (7, 4, 4)
    # keyed by its own radix so that the check does not depend on the design's code
    return df.groupBy((F.col("qty") * 20 + F.col("disc") * 5 + F.col("tax")).cast("long").alias("shifted_id")).agg(F.count("*").alias("n"))


@query("prep_cast_columns", """
    select cast(l_quantity as int) whole_qty, count(*) n, cast(sum(cast(l_linenumber as bigint)) as bigint) total_lines from lineitem group by 1""")
def prep_cast_columns(spark, sf):
    df = P.cast_columns(T.read_table(spark, sf, "lineitem").select("l_quantity", "l_linenumber"), {"l_quantity": "int", "l_linenumber": "long"})
    return df.groupBy(F.col("l_quantity").alias("whole_qty")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total_lines"))


@query("prep_count_where", """
    select count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') returned_open, count(*) filter (l_quantity > 45 and l_discount = 0.0) large_undiscounted
    from lineitem""")
def prep_count_where(spark, sf):
    return P.count_where(T.read_table(spark, sf, "lineitem"),
                         returned_open=(F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"),
                         large_undiscounted=(F.col("l_quantity") > 45) & (F.col("l_discount") == 0.0))


# ---- design ------------------------------------------------------------------------------

_MULTI = S.cells(fx.MULTI, "multi")
_SINGLE = S.cells(fx.SINGLE, "single")
_ALL_MULTI = f"every as (select cast(range as bigint) policy_id, {S.decode(fx.MULTI, 'range')} from range({fx.MULTI.n_policies}))"
_ALL_SINGLE = f"every as (select cast(range as bigint) policy_id, {S.decode(fx.SINGLE, 'range')} from range({fx.SINGLE.n_policies}))"


@query("design_policies", f"""with {_MULTI}, {_ALL_MULTI}
    select e.policy_id, e.qty, e.disc, e.tax, cast({S.profile(fx.MULTI, ['e.qty', 'e.disc', 'e.tax'])} as int) profile_id, coalesce(n, 0) n
    from every e left join cells using (policy_id)""")
def design_policies(spark, sf):
    cells = C.cell_moments(fx.MULTI, fx.lineitem_multi(spark, sf)).select("policy_id", "n")
    return D.policies(spark, fx.MULTI).join(cells, "policy_id", "left").fillna(0, ["n"])


@query("design_profiles", f"""with {_MULTI}
    select cast(range as int) profile_id, cast(range // 4 % 2 as int) active_qty, cast(range // 2 % 2 as int) active_disc, cast(range % 2 as int) active_tax,
        cast(coalesce(sum(n), 0) as bigint) n from range(8) left join cells on profile_id = range group by range""")
def design_profiles(spark, sf):
    cells = C.cell_moments(fx.MULTI, fx.lineitem_multi(spark, sf)).groupBy("profile_id").agg(F.sum("n").alias("n"))
    return D.profiles(spark, fx.MULTI).join(cells, "profile_id", "left").fillna(0, ["n"])


@query("design_encode", f"""with obs as ({S.OBS['multi']})
    select cast({S.policy(fx.MULTI)} as bigint) policy_id, cast({S.profile(fx.MULTI)} as int) profile_id, count(*) n, round(max(y), 6) top from obs group by 1, 2""")
def design_encode(spark, sf):
    df = D.encode(fx.MULTI, fx.lineitem_multi(spark, sf))
    return df.groupBy("policy_id", "profile_id").agg(F.count("*").alias("n"), F.round(F.max("y"), 6).alias("top"))


@query("design_local_ids", f"""with {_MULTI}, {_ALL_MULTI},
    loc as (select policy_id, cast({S.profile(fx.MULTI)} as int) profile_id from every),
    num as (select *, row_number() over (partition by profile_id order by policy_id) - 1 local_id from loc)
    select policy_id, profile_id, local_id, n from num join (select policy_id, n from cells) using (policy_id)""")
def design_local_ids(spark, sf):
    id_map = D.local_ids(fx.MULTI, D.policies(spark, fx.MULTI))
    local = (C.cell_moments(fx.MULTI, fx.lineitem_multi(spark, sf)).select("policy_id", "n")
             .join(id_map, "policy_id").select("profile_id", "local_id", "n"))
    back = D.to_global(local.withColumn("_l", F.col("local_id")), id_map).withColumnRenamed("_l", "local_id")
    return back.select("policy_id", "profile_id", "local_id", "n")


@query("design_subset", f"""with obs as ({S.OBS['multi']})
    select cast((qty) * 3 + tax as bigint) policy_id, count(*) n, round(avg(y), 6) mean_y from obs where qty > 0 and disc = 0 and tax > 0 group by 1""")
def design_subset(spark, sf):
    sub = D.subset_profile(fx.MULTI, fx.lineitem_multi(spark, sf), 5)
    small = D.masked_spec(fx.MULTI, 5)
    return sub.groupBy(small.policy_id().alias("policy_id")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))


@query("design_without_factor", f"""with {_SINGLE}
    select cast(qty * 16 + tax * 4 + flag as bigint) rest_id, count(*) n_cells, cast(sum(n) as bigint) n from cells group by 1""")
def design_without_factor(spark, sf):
    cells = C.cell_moments(fx.SINGLE, fx.lineitem_single(spark, sf)).select("n", *fx.SINGLE.level_columns())
    return (D.without_factor(cells, fx.SINGLE, "disc").groupBy("rest_id")
            .agg(F.count("*").alias("n_cells"), F.sum("n").alias("n")))


@query("design_dominance", f"""with {_MULTI}, {_ALL_MULTI}
    select a.policy_id, count(*) n_dominated, cast(coalesce(sum(c.n), 0) as bigint) n_rows from every a join every b on
        a.qty >= b.qty and a.disc >= b.disc and a.tax >= b.tax and (a.qty > 0) = (b.qty > 0) and (a.disc > 0) = (b.disc > 0) and (a.tax > 0) = (b.tax > 0)
    left join cells c on c.policy_id = b.policy_id group by a.policy_id""")
def design_dominance(spark, sf):
    cells = C.cell_moments(fx.MULTI, fx.lineitem_multi(spark, sf)).select(F.col("policy_id").alias("dominated_id"), "n")
    return (D.dominance(spark, fx.MULTI).join(cells, "dominated_id", "left").groupBy("policy_id")
            .agg(F.count("*").alias("n_dominated"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")))


@query("design_dummy_totals", f"""with {_SINGLE}
    select b.policy_id, cast(sum(a.n) as bigint) n, round(sum(a.sum_y), 6) sum_y from cells a join cells b on
        a.qty >= b.qty and a.disc >= b.disc and a.tax >= b.tax and a.flag >= b.flag group by b.policy_id""")
def design_dummy_totals(spark, sf):
    return rounded(D.dummy_totals(fx.SINGLE, C.cell_moments(fx.SINGLE, fx.lineitem_single(spark, sf))), 6)


@query("design_edges", f"""with {_SINGLE}
    select a.policy_id src, b.policy_id dst, case when a.qty <> b.qty then 0 when a.disc <> b.disc then 1 when a.tax <> b.tax then 2 else 3 end factor,
        round(b.mean_y - a.mean_y, 6) step from cells a join cells b on abs(a.qty - b.qty) + abs(a.disc - b.disc) + abs(a.tax - b.tax) + abs(a.flag - b.flag) = 1
        and b.policy_id > a.policy_id""")
def design_edges(spark, sf):
    cells = C.cell_moments(fx.SINGLE, fx.lineitem_single(spark, sf)).select("policy_id", "mean_y")
    side = lambda p, m: cells.select(F.col("policy_id").alias(p), F.col("mean_y").alias(m))
    return (D.lattice_edges(spark, fx.SINGLE).join(side("src", "a"), "src").join(side("dst", "b"), "dst")
            .select("src", "dst", "factor", F.round(F.col("b") - F.col("a"), 6).alias("step")))


_KEPT = (f"with {S.scores(fx.SINGLE, 'single', 1e-4, 15)}, best as (select cut_mask from scored where q <= 0.0055)")
_CUT = " and ".join(f"(a.{n} = b.{n} or ((cut_mask >> ({off} + least(a.{n}, b.{n}) - 1)) & 1) = 0)"
                    for n, off in zip(fx.SINGLE.names, fx.SINGLE.offsets))


@query("design_surviving_edges", f"""{_KEPT}
    select cut_mask, count(*) n_edges, cast(sum(a.policy_id * 1000 + b.policy_id) as bigint) id_sum from best, cells a join cells b
        on abs(a.qty - b.qty) + abs(a.disc - b.disc) + abs(a.tax - b.tax) + abs(a.flag - b.flag) = 1 and b.policy_id > a.policy_id
    where {_CUT} group by cut_mask""")
def design_surviving_edges(spark, sf):
    from poolwise.operators.search import exhaustive_set
    cells = C.cell_table(fx.SINGLE, fx.lineitem_single(spark, sf))
    best = exhaustive_set(fx.SINGLE, cells, 0.0055, 1e-4, 15)
    return (D.surviving_edges(fx.SINGLE, best).groupBy("cut_mask")
            .agg(F.count("*").alias("n_edges"), F.sum(F.col("src") * 1000 + F.col("dst")).alias("id_sum")))


@query("design_components", f"""{_KEPT}
    , assigned2 as (select b.cut_mask, {S.pool(fx.SINGLE, 'c', 'b.cut_mask')} pool_id, c.policy_id from best b, cells c)
    select cut_mask, policy_id, cast(min(policy_id) over (partition by cut_mask, pool_id) as bigint) component from assigned2""")
def design_components(spark, sf):
    from poolwise.operators.partitions import assign_pools
    from poolwise.operators.search import exhaustive_set
    cells = C.cell_table(fx.SINGLE, fx.lineitem_single(spark, sf))
    best = exhaustive_set(fx.SINGLE, cells, 0.0055, 1e-4, 15).select("profile_id", "cut_mask")
    nodes = (assign_pools(fx.SINGLE, best).select("cut_mask", F.col("policy_id").alias("node"))
             .join(cells.select(F.col("policy_id").alias("node")), "node", "left_semi"))
    found = D.connected_components(nodes, D.surviving_edges(fx.SINGLE, best), by=["cut_mask"])
    return found.select("cut_mask", F.col("node").alias("policy_id"), "component")


@query("design_sorted_check", f"""with {_MULTI}, w as (select profile_id, policy_id >= lag(policy_id, 1, policy_id) over (partition by profile_id order by qty, disc, tax) ok,
        mean_y >= lag(mean_y, 1, mean_y) over (partition by profile_id order by policy_id) up from cells)
    select profile_id, bool_and(ok) ids_sorted, bool_and(up) means_sorted from w group by profile_id""")
def design_sorted_check(spark, sf):
    cells = C.cell_moments(fx.MULTI, fx.lineitem_multi(spark, sf))
    order = cells.withColumn("levels", F.struct(*fx.MULTI.level_columns()))
    a = D.sorted_check(order, "profile_id", "levels", F.col("policy_id")).withColumnRenamed("is_sorted", "ids_sorted")
    b = D.sorted_check(order, "profile_id", "policy_id", F.col("mean_y")).withColumnRenamed("is_sorted", "means_sorted")
    return a.join(b, "profile_id")


# ---- cells ---------------------------------------------------------------------------------


@query("cells_moments", f"""with {_MULTI}, {_ALL_MULTI}
    select policy_id, coalesce(n, 0) n, round(coalesce(sum_y, 0), 6) sum_y, round(coalesce(ssw, 0), 6) ssw from every left join cells using (policy_id)""")
def cells_moments(spark, sf):
    full = C.complete_cells(fx.MULTI, C.cell_moments(fx.MULTI, fx.lineitem_multi(spark, sf)))
    return rounded(full.select("policy_id", "n", "sum_y", "ssw"))


_WIDE_OBS = f"""select {S.QTY} qty, {S.DISC} disc, {S.TAX} tax, {S.FLAG} flag, cast(ceil(p_size / 10) as int) size,
        case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 when 'PROMO' then 4 when 'SMALL' then 5 when 'STANDARD' then 6 end ptype,
        {S.OUTCOME} y from lineitem join part on l_partkey = p_partkey"""


@query("cells_means", f"""with {S.cells(fx.WIDE, _WIDE_OBS)}
    select count(*) filter (n > 0) filled, round(min(mean_y), 6) low, round(max(mean_y), 6) high, cast(sum(n) as bigint) n,
        {fx.WIDE.n_policies} - count(*) no_data from cells""")
def cells_means(spark, sf):
    full = C.complete_cells(fx.WIDE, C.cell_moments(fx.WIDE, fx.lineitem_wide(spark, sf)))
    return full.agg(F.count_if(F.col("n") > 0).alias("filled"), F.round(F.min("mean_y"), 6).alias("low"), F.round(F.max("mean_y"), 6).alias("high"),
                    F.sum("n").alias("n"), F.count_if(F.col("mean_y").isNull()).alias("no_data"))


@query("cells_lower_bound", f"""with {_MULTI}
    select profile_id, cast(sum(n) as bigint) n, round(sum(ssw) / (select sum(n) from cells), 9) lower_bound from cells group by profile_id""")
def cells_lower_bound(spark, sf):
    return rounded(C.profile_lower_bounds(C.cell_table(fx.MULTI, fx.lineitem_multi(spark, sf))), 9)


@query("cells_present", f"with {_MULTI} select profile_id, count(*) n_cells, cast(sum(n) as bigint) n from cells group by profile_id")
def cells_present(spark, sf):
    return C.observed_profiles(C.cell_moments(fx.MULTI, fx.lineitem_multi(spark, sf)))


@query("cells_empty", f"with {_SINGLE}, {_ALL_SINGLE} select policy_id from every where policy_id not in (select policy_id from cells)")
def cells_empty(spark, sf):
    return C.empty_cells(fx.SINGLE, C.cell_moments(fx.SINGLE, fx.lineitem_single(spark, sf)))


@query("cells_best", f"with {_SINGLE} select policy_id, n, round(mean_y, 6) mean_y from cells where mean_y = (select max(mean_y) from cells)")
def cells_best(spark, sf):
    return rounded(C.best_observed(C.cell_table(fx.SINGLE, fx.lineitem_single(spark, sf))).select("policy_id", "n", "mean_y"))


@query("cells_stratified", f"""with obs as ({S.OBS['orders']})
    select segment, cast({S.policy(fx.ORDERS)} as bigint) policy_id, count(*) n, round(sum(y), 7) sum_y, round(avg(y), 7) mean_y, round(var_pop(y) * count(*), 7) ssw
    from obs group by grouping sets ((segment, priority, ostatus, quartile), (priority, ostatus, quartile))""")
def cells_stratified(spark, sf):
    return rounded(C.stratified_cells(fx.ORDERS, fx.orders_strata(spark, sf), "segment").select("segment", "policy_id", "n", "sum_y", "mean_y", "ssw"), 7)


@query("cells_fit_mse", f"""with {_SINGLE}, j as (select o.y, c.mean_y from obs o join cells c using (qty, disc, tax, flag))
    select round(avg((y - mean_y) * (y - mean_y)), 9) mse from j""")
def cells_fit_mse(spark, sf):
    obs = fx.lineitem_single(spark, sf).withColumn("policy_id", fx.SINGLE.policy_id())
    cells = C.cell_moments(fx.SINGLE, fx.lineitem_single(spark, sf))
    rows = obs.join(F.broadcast(cells.select("policy_id", F.col("mean_y").alias("fitted"))), "policy_id")
    return rounded(C.fitted_mse(rows), 9)
