"""Queries: analytics over result tables.

The result table is made from the facts: one setting per line number, one
simulation per ship month, one model per weekday, with an error, a size,
an overlap and a flag each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwise.functions import results as A
from poolwise.plans.registry import query, rounded
from poolwise.runtime import materialize
from poolwise.sources.tables import read_table

_RES = """res as (select l_linenumber n_per_pol, cast(month(l_shipdate) as int) sim_num, cast(isodow(l_shipdate) - 1 as int) model, round(var_pop(l_quantity) / 100, 6) mse, cast(count(distinct l_returnflag || l_linestatus) as bigint) num_pools,
        round(avg(l_discount) * 10, 9) gap, round(avg(l_tax) * 10, 9) iou, case when avg(l_extendedprice) > 51500 then 1 else 0 end found, count(*) n_set from lineitem group by 1, 2, 3),
    lossed as (select *, round(mse + 0.1 * num_pools, 6) loss from res)"""


def results(spark, sf):
    facts = read_table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("n_per_pol"), F.month("l_shipdate").alias("sim_num"), F.weekday("l_shipdate").alias("model"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").alias("pool"))
    df = facts.groupBy("n_per_pol", "sim_num", "model").agg(
        F.round(F.var_pop("l_quantity") / 100, 6).alias("mse"), F.size(F.collect_set("pool")).cast("long").alias("num_pools"), F.round(F.avg("l_discount") * 10, 9).alias("gap"),
        F.round(F.avg("l_tax") * 10, 9).alias("iou"), F.when(F.avg("l_extendedprice") > 51500, 1).otherwise(0).alias("found"), F.count("*").alias("n_set"))
    return materialize(df.withColumn("loss", F.round(F.col("mse") + 0.1 * F.col("num_pools"), 6)), "results")


def _four(c):
    # means end after a few digits, so they are compared further out than variances
    return ", ".join(f"round({f}({c}), {d}) {c}_{n}" for f, n, d in (("min", "min", 9), ("avg", "mean", 12), ("max", "max", 9), ("var_samp", "var", 9)))


@query("res_summary", f"with {_RES} select n_per_pol, sim_num, {_four('mse')}, {_four('iou')} from lossed group by 1, 2")
def res_summary(spark, sf):
    df = A.summarise(results(spark, sf), ["n_per_pol", "sim_num"], ["mse", "iou"])
    return rounded(rounded(df, 12, "mse_mean", "iou_mean"), 9, *[f"{c}_{k}" for c in ("mse", "iou") for k in ("min", "max", "var")])


@query("res_broadcast", f"with {_RES} select n_per_pol, sim_num, model, mse, " + ", ".join(f"round({f}(mse) over (partition by n_per_pol), 6) mse_{n}" for f, n in (("min", "min"), ("avg", "mean"), ("max", "max"), ("var_samp", "var"))) + " from lossed")
def res_broadcast(spark, sf):
    return rounded(A.broadcast_summary(results(spark, sf).select("n_per_pol", "sim_num", "model", "mse"), ["n_per_pol"], "mse"))


@query("res_first_per_key", f"with {_RES} select n_per_pol, sim_num, model, loss, found from lossed qualify row_number() over (partition by n_per_pol, sim_num order by loss, model) = 1")
def res_first_per_key(spark, sf):
    return A.first_per_key(results(spark, sf).select("n_per_pol", "sim_num", "model", "loss", "found"), ["n_per_pol", "sim_num"], ["loss", "model"])


@query("res_two_level_mean", f"with {_RES}, s as (select n_per_pol, sim_num, avg(mse) mse, avg(iou) iou from lossed group by 1, 2) select n_per_pol, round(avg(mse), 6) mse, round(avg(iou), 6) iou from s group by 1")
def res_two_level_mean(spark, sf):
    return rounded(A.two_level_mean(results(spark, sf), ["n_per_pol"], ["sim_num"], ["mse", "iou"]))


@query("res_best_row", f"with {_RES} select n_per_pol, model, sim_num, loss, num_pools, iou from lossed qualify row_number() over (partition by n_per_pol order by loss, model * 100 + sim_num) = 1")
def res_best_row(spark, sf):
    df = results(spark, sf).select("n_per_pol", "model", "sim_num", "loss", "num_pools", "iou").withColumn("tie", F.col("model") * 100 + F.col("sim_num"))
    return A.best_row(df, ["n_per_pol"], "loss", "tie").drop("tie")


@query("res_derived", f"with {_RES} select n_per_pol, sim_num, model, round(mse + 0.1 * num_pools, 6) loss, round(gap * gap, 10) gap_sq, round(n_set / sum(n_set) over (partition by n_per_pol), 9) fraction from lossed")
def res_derived(spark, sf):
    from poolwise.functions.groups import attach
    df = attach(results(spark, sf), ["n_per_pol"], n_total=F.sum("n_set"))
    return A.derived_columns(df, 0.1).select("n_per_pol", "sim_num", "model", F.round("loss", 6).alias("loss"), F.round("gap_sq", 10).alias("gap_sq"), F.round("fraction", 9).alias("fraction"))


@query("res_found_so_far", f"""with {_RES} select n_per_pol, sim_num, model, row_number() over w model_number, max(found) over w found_by_now from lossed window w as (partition by n_per_pol, sim_num order by loss, model)""")
def res_found_so_far(spark, sf):
    return A.found_so_far(results(spark, sf), ["n_per_pol", "sim_num"], ["loss", "model"], "found").select("n_per_pol", "sim_num", "model", "model_number", "found_by_now")


_EPS = f"{_RES}, eps as (select *, round((loss - min(loss) over (partition by n_per_pol, sim_num)) / min(loss) over (partition by n_per_pol, sim_num) * 100, 6) eps from lossed)"


def _eps(spark, sf):
    return materialize(A.epsilon_percent(results(spark, sf), ["n_per_pol", "sim_num"]).withColumn("eps", F.round("eps", 6)), "eps")


@query("res_epsilon", f"with {_EPS} select n_per_pol, sim_num, model, eps from eps")
def res_epsilon(spark, sf):
    return _eps(spark, sf).select("n_per_pol", "sim_num", "model", "eps")


# 15 equal-width, right-closed intervals, named by their upper edge's number; 0 is the smallest value itself
_CUT = f"""{_EPS}, rng as (select min(eps) lo, max(eps) hi from eps), edges as (select cast(range as int) k, round(lo + (hi - lo) * range / 15, 9) edge from range(16), rng),
    cutted as (select n_per_pol, sim_num, model, eps, found, (select min(edge) from edges where edge >= round(eps, 9)) eps_level from eps)"""


@query("res_equal_width_cut", f"with {_CUT} select eps_level, count(*) n from cutted group by 1")
def res_equal_width_cut(spark, sf):
    return A.cut_by_equal_width(_eps(spark, sf), "eps", 15, "eps_level").groupBy("eps_level").agg(F.count("*").alias("n"))


_PRESENT = f"""{_CUT}, lv as (select n_per_pol, sim_num, k, max(found) present from cutted join edges on edge = eps_level group by 1, 2, 3),
    dense as (select g.n_per_pol, g.sim_num, e.k, coalesce(lv.present, 0) present from (select distinct n_per_pol, sim_num from lv) g cross join edges e left join lv using (n_per_pol, sim_num, k))"""


def _levels(spark, sf):
    """Found flag per setting, simulation and loss interval, intervals numbered 0 to 15."""
    df = A.cut_by_equal_width(_eps(spark, sf), "eps", 15, "eps_level")
    rng = df.withColumns({"_lo": df.agg(F.min("eps")).scalar(), "_hi": df.agg(F.max("eps")).scalar()})
    return (rng.withColumn("k", F.round((F.col("eps_level") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 15).cast("int"))
            .groupBy("n_per_pol", "sim_num", "k").agg(F.max("found").alias("present")))


@query("res_densify", f"with {_PRESENT} select n_per_pol, sim_num, k, present from dense")
def res_densify(spark, sf):
    return A.densify(_levels(spark, sf), ["n_per_pol", "sim_num"], "k", list(range(16)), "present")


@query("res_presence_rate", f"with {_PRESENT}, c as (select n_per_pol, k, max(present) over (partition by n_per_pol, sim_num order by k) present from dense) select n_per_pol, k, round(avg(present), 9) rate from c group by 1, 2")
def res_presence_rate(spark, sf):
    dense = A.densify(_levels(spark, sf).withColumnRenamed("present", "flag"), ["n_per_pol", "sim_num"], "k", list(range(16)), "flag")
    return rounded(A.rate_per_level(A.cumulative_presence(dense, ["n_per_pol", "sim_num"], "k", "flag"), ["n_per_pol", "k"]), 9)


@query("res_pad_series", f"""with {_RES}, s as (select n_per_pol, sim_num, row_number() over w model_number, max(found) over w found_by_now from lossed where loss <= 2.65 window w as (partition by n_per_pol, sim_num order by loss, model)),
    l as (select n_per_pol, sim_num, max(model_number) top, arg_max(found_by_now, model_number) last from s group by 1, 2), m as (select n_per_pol, max(top) longest from l group by 1)
    select n_per_pol, sim_num, model_number, found_by_now from s union all
    select l.n_per_pol, sim_num, unnest(range(top + 1, longest + 1)), last from l join m using (n_per_pol)""")
def res_pad_series(spark, sf):
    runs = A.found_so_far(results(spark, sf).where("loss <= 2.65"), ["n_per_pol", "sim_num"], ["loss", "model"], "found")
    return A.pad_series(materialize(runs, "runs"), ["n_per_pol", "sim_num"], "model_number", "found_by_now", ["n_per_pol"])


@query("res_extend_axis", f"""with {_PRESENT}, c as (select k, max(present) over (partition by n_per_pol, sim_num order by k) present from dense), r as (select k * 1.0 axis, round(avg(present), 9) rate from c group by 1)
    select cast(axis as double) axis, rate from r union all select cast(15 + 3 * i as double), (select max(rate) from r) from range(4) t(i) where 15 + 3 * i < 25""")
def res_extend_axis(spark, sf):
    dense = A.densify(_levels(spark, sf).withColumnRenamed("present", "flag"), ["n_per_pol", "sim_num"], "k", list(range(16)), "flag")
    rate = A.rate_per_level(A.cumulative_presence(dense, ["n_per_pol", "sim_num"], "k", "flag"), ["k"])
    rate = materialize(rate.select(F.col("k").cast("double").alias("axis"), F.round("rate", 9).alias("rate")), "rate")
    return A.extend_axis(rate, "axis", "rate", 15.0, 25.0, 3.0)


@query("res_never_reaching", f"with {_RES} select n_per_pol, sim_num from lossed where loss <= 2.65 group by 1, 2 having max(found) = 0")
def res_never_reaching(spark, sf):
    return A.never_reaching(results(spark, sf).where("loss <= 2.65"), ["n_per_pol", "sim_num"], "found")


@query("res_named_aggregates", f"with {_RES} select n_per_pol, num_pools, round(avg(mse), 6) mean_mse, round(avg(iou), 6) mean_iou, round(stddev_samp(mse), 6) std_mse from lossed group by 1, 2")
def res_named_aggregates(spark, sf):
    return rounded(A.named_aggregates(results(spark, sf), ["n_per_pol", "num_pools"], ["mse", "iou"], ["mse"]))


@query("res_union_of_runs", f"with {_RES} select n_per_pol, run, count(*) n, round(avg(loss), 6) loss from (select *, 'first' run from lossed where found = 1 union all select *, 'second' from lossed where found = 0) where n_per_pol in (1, 3, 5) group by 1, 2")
def res_union_of_runs(spark, sf):
    df = results(spark, sf)
    runs = A.union_of_runs([df.where("found = 1").withColumn("run", F.lit("first")), df.where("found = 0").withColumn("run", F.lit("second"))], [1, 3, 5])
    return runs.groupBy("n_per_pol", "run").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))
