import random
from itertools import product

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolwise import FactorSpec
from poolwise import runtime
from poolwise.functions import posterior as B, results as A
from poolwise.functions.running import running
from poolwise.operators import cells as C, external as E, partitions as P, prep, slopes as L, sparse as Z, treatment as T
from poolwise.sources import tables as S


def test_running_with_a_heavy_group(spark):
    rng = random.Random(1)
    rows = [("hot" if k % 3 else f"g{k % 50}", rng.randint(0, 20), k, rng.randint(1, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, ["g", "v", "k", "w"])
    got = running(df, ["g"], ["v", "k"], sums={"total": "w"}).toPandas().set_index("k").sort_index()
    pdf = pd.DataFrame(rows, columns=["g", "v", "k", "w"]).sort_values(["g", "v", "k"])
    pdf["position"] = pdf.groupby("g").cumcount() + 1
    pdf["total"] = pdf.groupby("g")["w"].cumsum()
    pdf = pdf.set_index("k").sort_index()
    assert (got["position"] == pdf["position"]).all() and (got["total"] == pdf["total"]).all()


def test_quantile_edges_with_ties(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=400), np.full(300, 0.25)])
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], ["v", "g"])
    for parts in (3, 4, 10):
        edges = prep.quantile_edges(df, "v", parts).first()[0]
        assert np.allclose(edges, np.quantile(values, np.arange(parts + 1) / parts))
    by_group = {r.g: r.edges for r in prep.quantile_edges(df, "v", 4, by=["g"]).collect()}
    for g in (0, 1):
        assert np.allclose(by_group[g], np.quantile(values[g::2], np.arange(5) / 4))
    sketch = prep.quantile_edges(df, "v", 4, exact=False).first()[0]
    assert len(sketch) == 5


def test_quantile_cut_drops_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 6 + [(2.0,), (3.0,), (None,)], "v double")
    got = [(r.v, r.lev) for r in prep.quantile_cut(df, "v", 4, "lev").collect()]
    want = pd.qcut(pd.Series([v for v, _ in got]), 4, duplicates="drop", labels=False)
    assert all((pd.isna(w) and lev is None) or w == lev for w, (_, lev) in zip(want, got))


def test_band_and_recode_keep_nulls(spark):
    df = spark.createDataFrame([(1,), (18,), (19,), (None,)], "a int")
    got = [tuple(r) for r in df.select(prep.band("a", [18, 30], ["x", "y", "z"]), prep.recode("a", {1: "one"}, default="other", null_label="none")).collect()]
    assert got == [("x", "one"), ("x", "other"), ("y", "other"), (None, "none")]


def test_left_join_matches_on_the_key(spark):
    left = spark.createDataFrame([(5, 1.0), (9, 2.0)], ["k", "v"])
    right = spark.createDataFrame([(9, 3.0), (0, 4.0)], ["k", "v"])
    got = {r.k: (r.v_x, r.v_y) for r in prep.left_join(left, right, ["k"]).collect()}
    assert got == {5: (1.0, None), 9: (2.0, 3.0)}


def test_shared_dir_follows_the_session(spark):
    assert runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_bounded_hints_only_small_tables(spark):
    df = spark.range(3)
    small, large = runtime.bounded(df, 10), runtime.bounded(df, runtime.BROADCAST_ROWS + 1)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_cells_scan_prunes_columns_and_aggregates_before_the_shuffle(spark, sf_dir):
    from poolwise.plans import fixtures as fx
    plan = C.cell_moments(fx.SINGLE, fx.lineitem_single(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double,l_returnflag:string>" in plan
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.rindex("HashAggregate")


def test_scoring_forms_no_product_join(spark, sf_dir):
    from poolwise.plans import fixtures as fx
    cells = C.cell_table(fx.SINGLE, fx.lineitem_single(spark, sf_dir))
    plan = P.score_space(fx.SINGLE, cells, 1e-4, 15)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_weights_do_not_underflow(spark):
    scored = spark.createDataFrame([(5000.0,), (5001.0,)], ["q"])
    got = sorted(r.weight for r in B.weights(scored).collect())
    assert abs(got[1] - 1 / (1 + np.exp(-1))) < 1e-12


@pytest.mark.parametrize("bins,want", [(5, [0, 0, 1, 2, 3, 3, 4]), (3, [0, 0, 0, 1, 2, 2, 2])])
def test_sigma_bins_on_their_edges(spark, bins, want):
    df = spark.createDataFrame([(e,) for e in (3.0, 2.0, 0.5, 0.0, -0.5, -2.0, -2.1)], ["e"])
    assert [r[0] for r in df.select(B.sigma_bin(F.col("e"), F.lit(1.0), bins)).collect()] == want


def _slope_case(spark, seed=4):
    spec = FactorSpec(["a", "b"], [4, 3])
    rng = random.Random(seed)
    rows = []
    for _ in range(200):
        a, b = rng.randrange(1, 4), rng.randrange(1, 3)
        x = 1000 + rng.random()
        rows.append((a, b, float(a), x, 2 * x + a + rng.gauss(0, 0.1)))
    return spec, rows, spark.createDataFrame(rows, ["a", "b", "d", "x", "y"])


def test_slopes_against_least_squares(spark):
    """One regressor is the level of a factor: constant in every pool that fixes it."""
    spec, rows, obs = _slope_case(spark)
    cells = runtime.materialize(L.slope_cells(spec, obs, ["d", "x"]))
    boxes = runtime.materialize(L.slope_boxes(spec, cells, 2))
    got = {r.cut_mask: r.sse for r in L.slope_scores(spec, P.enumerate_partitions(spark, spec, 3), cells, boxes, 0.1).collect()}
    for mask in brute.masks_of(spec, 3):
        sse = 0.0
        for pool in brute.pools_of(spec, 3, mask):
            part = np.array([r[2:] for r in rows if r[:2] in set(pool)])
            x, y = part[:, :2] - part[:, :2].mean(axis=0), part[:, 2] - part[:, 2].mean()
            beta = np.linalg.lstsq(x, y, rcond=1e-8)[0]
            sse += ((y - x @ beta) ** 2).sum()
        assert abs(got[mask] - sse) < 1e-5


def test_puffer_equals_its_definition(spark):
    spec = FactorSpec(["a", "b"], [4, 3])
    rng = random.Random(8)
    rows = [(rng.randrange(1, 4), rng.randrange(1, 3), rng.gauss(1, 1)) for _ in range(80)]
    cells = C.cell_table(spec, spark.createDataFrame(rows, ["a", "b", "y"]))
    names = brute.cells_of(spec, 3)
    x = np.array([[float(r[0] >= c[0] and r[1] >= c[1]) for c in names] for r in rows])
    y = np.array([r[2] for r in rows])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    z = (u @ vt).T @ (u @ ((u.T @ y) / s))
    reg = 0.002
    want = np.sign(z) * np.maximum(np.abs(z) - reg * len(rows), 0)
    got = {r.policy_id: r.alpha for r in Z.puffer_lasso(spec, cells, reg).collect()}
    assert np.allclose([got[brute.policy_id(spec, c)] for c in names], want, atol=1e-9)


def test_lasso_meets_its_conditions_on_rows(spark):
    spec = FactorSpec(["a", "b"], [3, 3])
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(3), rng.gauss(1, 1)) for _ in range(120)]
    cells = C.cell_table(spec, spark.createDataFrame(rows, ["a", "b", "y"]))
    got = {r.policy_id: r.alpha for r in Z.lasso(spec, cells, 0.05).collect()}
    every = list(product(range(3), range(3)))
    dominates = lambda p, c: all(l >= m and (l > 0) == (m > 0) for l, m in zip(p, c))
    x = np.array([[float(dominates(r[:2], c)) for c in every] for r in rows])
    y, alpha = np.array([r[2] for r in rows]), np.array([got[brute.policy_id(spec, c)] for c in every])
    grad = x.T @ (y - x @ alpha) / len(rows)
    assert np.all(np.abs(grad) <= 0.05 + 1e-8)
    assert np.allclose(grad[alpha != 0], 0.05 * np.sign(alpha[alpha != 0]), atol=1e-8)


def test_lasso_in_rounds_equals_lasso_in_a_task(spark):
    spec = FactorSpec(["a", "b"], [4, 3])
    rng = random.Random(12)
    rows = [r for r in ((rng.randrange(4), rng.randrange(3), rng.gauss(1, 1)) for _ in range(150)) if r[:2] not in {(2, 1), (1, 2)}]
    cells = C.cell_table(spec, spark.createDataFrame(rows, ["a", "b", "y"]))
    for reg in (0.05,):  # columns over empty cells are alike, so fits are compared, not coefficients
        rounds, task = (Z.lasso(spec, cells, reg, 1e-5, 2000, n).cache() for n in (0, 10**6))
        fits = [{r.policy_id: r.fitted for r in Z.fitted_cells(spec, cells, a).collect()} for a in (rounds, task)]
        assert rounds.count() == task.count() == 12 and all(abs(fits[0][k] - fits[1][k]) < 1e-3 for k in fits[1])
        sizes = [a.agg(F.sum(F.abs("alpha"))).first()[0] for a in (rounds, task)]
        assert abs(sizes[0] - sizes[1]) < 1e-3
        assert Z.optimality_gap(spec, cells, Z.fitted_cells(spec, cells, rounds), rounds, reg).first()["gap"] < 1e-4
    with pytest.raises(Exception, match="violates"):
        Z.lasso(spec, cells, 1e-3, tolerance=0.0, sweeps=1, task_cells=0).count()


def test_sparse_fits_take_designs_of_any_size(spark):
    spec = FactorSpec(["a", "b", "c", "d"], [10, 10, 10, 10])
    rows = [(1, 1, 1.0), (1, 1, 3.0), (2, 1, 5.0), (1, 2, 4.0), (2, 2, 10.0)]
    cells = C.cell_table(spec, spark.createDataFrame([(a, b, 1, 1, y) for a, b, y in rows], [*spec.names, "y"]))
    z = {(1, 1): 2.0, (2, 1): 3.0, (1, 2): 2.0, (2, 2): 3.0}
    got = {r.policy_id: r.alpha for r in Z.puffer_lasso(spec, cells, 0.1).collect()}
    assert got == {brute.policy_id(spec, (*c, 1, 1)): pytest.approx(v - 0.5) for c, v in z.items()}
    alpha = Z.lasso(spec, cells, 1e-3)
    fitted = Z.fitted_cells(spec, cells, alpha)
    assert alpha.count() == 10_000 and Z.optimality_gap(spec, cells, fitted, alpha, 1e-3).first()["gap"] < 1e-8
    with pytest.raises(ValueError, match="rank"):
        Z.puffer_lasso(spec, cells.where("policy_id != 1111"), 0.1)
    with pytest.raises(Exception, match="violates"):
        Z.lasso(spec, cells, 1e-3, tolerance=0.0, sweeps=1).count()


def test_merged_effects_against_rows(spark):
    spec = FactorSpec(["t", "a"], [2, 4])
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(1, 4), rng.gauss(0, 1)) for _ in range(60)]
    cells = C.cell_table(spec, spark.createDataFrame(rows, ["t", "a", "y"]))
    boxes = P.box_moments(spec, cells)
    pairs = spark.createDataFrame([(1, 1, 2)], "rest_profile int, mask_t long, mask_c long")
    over = {(r.box_t, r.box_c) for r in T.overlap(spec, pairs, "t").collect()}
    pools_t, pools_c = [{1}, {2, 3}], [{1, 2}, {3}]
    mean = lambda *parts: np.mean([y for t, a, y in rows if any(t == k and a in pool for k, pool in parts)])
    for merge in [[], *[[m] for m in sorted(over)]]:
        entry = pairs.withColumn("merges", F.from_json(F.lit(str([{"box_t": t, "box_c": c} for t, c in merge]).replace("'", '"')),
                                                       "array<struct<box_t:bigint,box_c:bigint>>"))
        found = T.effects_by_cell(spec, T.merged_effects(spec, entry, boxes, "t")).collect()
        joined = None
        for r in found:  # the merged pools, told by their boxes
            if (r.box_t, r.box_c) in merge:
                a = r.control_id % 4
                joined = (next(p for p in pools_t if a in p), next(p for p in pools_c if a in p))
        for r in found:
            a = r.control_id % 4
            t, c = next(p for p in pools_t if a in p), next(p for p in pools_c if a in p)
            both = [(1, joined[0]), (0, joined[1])] if joined else []
            want = mean(*(both if joined and t == joined[0] else [(1, t)])) - mean(*(both if joined and c == joined[1] else [(0, c)]))
            assert abs(r.effect - want) < 1e-9
        assert len(found) == 3


def _permissible(pools, spec):
    """All pools boxes, and each step inside a pool is inside a pool for all other settings."""
    where = {c: k for k, pool in enumerate(pools) for c in pool}
    for pool in pools:
        box = list(product(*[range(min(a), max(a) + 1) for a in zip(*pool)]))
        if any(c not in pool for c in box):
            return False
    for i, r in enumerate(spec.levels):
        for low in range(1, r - 1):
            same = set()
            for c in where:
                if c[i] == low:
                    up = c[:i] + (low + 1,) + c[i + 1:]
                    same.add(where[c] == where[up])
            if len(same) > 1:
                return False
    return True


def test_permissible_against_brute_force(spark):
    spec = FactorSpec(["a", "b"], [4, 3])
    cells = brute.cells_of(spec, 3)
    rng = random.Random(6)
    cases = [[brute.pool_of(spec, c, m) for c in cells] for m in brute.masks_of(spec, 3)]
    cases += [[rng.randrange(3) for _ in cells] for _ in range(20)] + [[0 if c[0] == 1 else (1 if c[1] == 1 else 2) for c in cells]]
    rows, want = [], {}
    for k, labels in enumerate(cases):
        names = {l: n for n, l in enumerate(dict.fromkeys(labels))}
        pools = [[c for c, l in zip(cells, labels) if names[l] == n] for n in range(len(names))]
        want[k] = _permissible(pools, spec)
        rows += [(k, names[l], brute.policy_id(spec, c)) for c, l in zip(cells, labels)]
    got = {r.partition_id: r.is_permissible for r in E.permissible(spec, spark.createDataFrame(rows, ["partition_id", "pool_id", "policy_id"])).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_merge_cost_is_the_growth_of_the_error(spark):
    spec = FactorSpec(["t", "a"], [2, 4])
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(1, 4), rng.gauss(0, 1)) for _ in range(60)]
    cells = C.cell_table(spec, spark.createDataFrame(rows, ["t", "a", "y"]))
    boxes = P.box_moments(spec, cells)
    pairs = spark.createDataFrame([(1, 1, 2)], "rest_profile int, mask_t long, mask_c long")
    got = {(r.box_t, r.box_c): r.d_sse for r in T.merge_costs(spec, T.overlap(spec, pairs, "t"), boxes).collect()}
    sse = lambda v: ((np.array(v) - np.mean(v)) ** 2).sum()
    pools_t, pools_c = [[1], [2, 3]], [[1, 2], [3]]
    want = []
    for pt in pools_t:
        for pc in pools_c:
            if set(pt) & set(pc):
                y1 = [y for t, a, y in rows if t == 1 and a in pt]
                y0 = [y for t, a, y in rows if t == 0 and a in pc]
                want.append(sse(y1 + y0) - sse(y1) - sse(y0))
    assert np.allclose(sorted(got.values()), sorted(want)) and len(got) == 3


def test_model_set_round_trip_replaces_only_its_own(spark, tmp_path):
    one = spark.createDataFrame([(3, 5, 2, 0.5)], "profile_id int, cut_mask long, h long, q double")
    path = str(tmp_path / "sets")
    for outcome in ("y", "z", "y"):
        S.save_model_set(path, outcome, "base", one, one, {"theta": 1.0})
    assert S.load_model_set(spark, path)["partitions"].count() == 2
    assert S.load_model_set(spark, path, "z")["parameters"].first().theta == 1.0


def test_pending_and_csv(spark, tmp_path):
    todo = spark.createDataFrame([(3, 4), (4, 4)], ["m", "r"])
    path = str(tmp_path / "done")
    S.write_sweep(todo.where("m = 3").withColumn("v", F.lit(1)), path, ["m", "r"])
    assert [tuple(r) for r in S.pending(todo, spark.read.parquet(path), ["m", "r"]).collect()] == [(4, 4)]
    csv = str(tmp_path / "csv")
    S.write_csv(todo, csv, index_column="idx")
    back = S.read_csv(spark, csv, "idx long, m long, r long", index_column="idx")
    assert sorted(tuple(r) for r in back.collect()) == [(3, 4), (4, 4)]


def test_pad_and_densify(spark):
    runs = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0)], ["sim", "k", "v"])
    padded = sorted(tuple(r) for r in A.pad_series(runs, ["sim"], "k", "v").collect())
    assert padded == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0)]
    dense = sorted(tuple(r) for r in A.densify(runs, ["sim"], "k", [1, 2, 3], "v").collect())
    assert dense == [(1, 1, 0), (1, 2, 1), (1, 3, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)]


def test_effect_error_counts_cells_of_one_side(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 1.0)], "policy_id long, beta double")
    b = spark.createDataFrame([(2, 1.0), (3, 4.0)], "policy_id long, beta double")
    assert B.effect_error(a, b).first()[0] == 5.0 and B.effect_error(a.limit(0), b.limit(0)).first()[0] == 0.0


def test_quantiles_of_a_heavy_group(spark):
    """Most rows in one group, many of them alike, a null group, and shares at both ends."""
    rng = np.random.default_rng(7)
    groups = {"heavy": rng.normal(size=4000).round(2), "light": rng.normal(size=7), None: np.array([5.0, 1.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("light", None), ("empty", None)]
    shares = (0.0, 0.1, 0.5, 0.975, 1.0)
    got = {r["g"]: r["quantiles"] for r in prep.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), "v", shares, ["g"]).collect()}
    assert got.keys() == groups.keys()
    assert all(np.allclose(got[g], np.quantile(values, shares)) for g, values in groups.items())
    summary = {r["category"]: r for r in B.category_summary(spark.createDataFrame(rows, "g string, beta double"), F.col("g"), shares=(0.25, 0.5)).collect()}
    assert summary[None]["median_effect"] == 3.0 and summary["heavy"]["n_cells"] == 4000 and summary["empty"]["quantiles"] is None


def test_overlap_compares_boxes(spark):
    spec = FactorSpec(["a", "b"], [4, 3])
    parts = P.enumerate_partitions(spark, spec, 3)
    assign = P.assign_pools(spec, parts).selectExpr("cut_mask as partition_id", "pool_id + 100 * cut_mask as pool_id", "policy_id")
    extra = spark.createDataFrame([(90, 1, 4), (90, 1, 8), (90, 2, 5), (91, 1, 4)], "partition_id long, pool_id long, policy_id long")  # no box; part of a partition
    found = {r[0] for r in E.overlap_with_set(spec, assign.unionByName(extra), parts.where("cut_mask <> 2")).collect()}
    assert found == {r["cut_mask"] for r in parts.collect()} - {2}


def test_written_tables_have_an_owner(spark):
    import os
    table = runtime.materialize(spark.range(3), "owned")
    path = table._written_to.removeprefix("file:")
    assert os.path.isdir(path)
    runtime.discard(table, spark.range(1))
    assert not os.path.exists(path)
