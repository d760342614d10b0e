import random
from collections import Counter
from itertools import product

import brute
import pytest
from pyspark.sql import functions as F

from poolwise import FactorSpec, runtime
from poolwise.operators import cells as C, design as D, models as M, partitions as P, search as R


def random_obs(spark, spec, n, seed, levels_from=0, skip=0.0):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        cell = tuple(rng.randrange(levels_from, r) for r in spec.levels)
        if rng.random() >= skip:
            rows.append((*cell, round(sum(cell) * 0.3 + rng.gauss(0, 1), 6)))
    return spark.createDataFrame(rows, [*spec.names, "y"]), [(r[:-1], r[-1]) for r in rows]


def test_worked_example_has_four_pools(spark):
    spec = FactorSpec(["a", "b", "c"], [4, 3, 3])
    mask = (1 << spec.offsets[0]) | (1 << spec.offsets[2])
    part = spark.createDataFrame([(7, mask)], "profile_id int, cut_mask long")
    assigned = P.assign_pools(spec, part)
    assert assigned.count() == 12
    assert assigned.select("pool_id").distinct().count() == 4
    assert part.select(spec.pool_count()).first()[0] == 4


def test_partition_counts_by_size(spark):
    spec = FactorSpec(["a", "b"], [5, 5])
    counts = P.count_by_size(P.enumerate_partitions(spark, spec, 3)).collect()
    assert {r.h: r.n_partitions for r in counts} == {1: 1, 2: 6, 3: 6, 4: 11, 6: 18, 8: 6, 9: 9, 12: 6, 16: 1}


@pytest.mark.parametrize("levels", [(4, 3, 2), (2, 2), (6, 3), (10, 2, 3)])
def test_all_scores_against_brute_force(spark, levels):
    """Both scoring routes, all profiles; the last design is past the size of the literal tables."""
    spec = FactorSpec([f"f{i}" for i in range(len(levels))], levels)
    obs, rows = random_obs(spark, spec, 120, seed=sum(levels), skip=0.2)
    cells = C.cell_table(spec, obs)
    direct = {(r.profile_id, r.cut_mask): (r.q, r.h) for r in P.score_space(spec, cells, 0.05).collect()}
    summed = P.with_loss(P.space_errors(spec, P.box_moments(spec, cells)), cells, 0.05)
    summed = {(r.profile_id, r.cut_mask): (r.q, r.h) for r in summed.collect()}
    needed = P.enumerate_partitions(spark, spec).join(cells.select("profile_id").distinct(), "profile_id")
    some = P.needed_box_moments(spec, cells, spec.mask_boxes(needed))
    third = {(r.profile_id, r.cut_mask): (r.q, r.h) for r in P.score_partitions(spec, needed, cells, 0.05, boxes=some).collect()}
    seen = {r.profile_id for r in cells.select("profile_id").distinct().collect()}
    want = {(p, m): brute.loss(spec, rows, p, m, 0.05, len(rows)) for p in seen for m in brute.masks_of(spec, p)}
    assert set(direct) == set(summed) == set(want) == set(third)
    for key, (q, h) in want.items():
        for got in (direct[key], summed[key], third[key]):
            assert got[1] == h and abs(got[0] - q) < 1e-9


def test_squares_do_not_cancel_far_from_zero(spark):
    spec = FactorSpec(["a"], [4])
    rows = [(1, 1e8 + 0.1), (1, 1e8 + 0.3), (2, 1e8 + 0.2), (3, 1e8 + 0.7)]
    cells = C.cell_table(spec, spark.createDataFrame(rows, ["a", "y"]))
    got = {r.cut_mask: r.sse for r in P.score_space(spec, cells, 0.0, 1).collect()}
    ys = [0.1, 0.3, 0.2, 0.7]
    mean = sum(ys) / 4
    assert abs(got[0] - sum((y - mean) ** 2 for y in ys)) < 1e-6


def test_moment_loss_equals_row_loss(spark):
    spec = FactorSpec(["a", "b"], [5, 4])
    obs, _ = random_obs(spark, spec, 300, seed=3, levels_from=1)
    cells = C.cell_table(spec, obs)
    part = P.enumerate_partitions(spark, spec, 3).where("cut_mask = 11")
    fitted = P.predict(spec, obs, part, P.box_moments(spec, cells))
    mse = C.fitted_mse(fitted).first()[0]
    assert abs(P.score_partitions(spec, part, cells, 0.0).first().q - mse) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_frontier_equals_exhaustive(spark, seed):
    spec = FactorSpec(["a", "b", "c"], [6, 4, 3])
    obs, _ = random_obs(spark, spec, 400, seed=seed, levels_from=1, skip=0.3)
    cells = C.cell_table(spec, obs)
    best = R.exhaustive_set(spec, cells, 1e9, 0.01, 7).agg(F.min("q")).first()[0]
    for budget in (None, 6):
        a = R.exhaustive_set(spec, cells, best * 1.2 + 1e-9, 0.01, 7, budget)
        b = R.frontier_set(spec, cells, best * 1.2 + 1e-9, 0.01, 7, budget)
        assert a.count() > 1
        assert R.set_difference(a, b).count() == 0


def test_frontier_makes_few_boxes(spark, monkeypatch):
    """Of all boxes only those that live nodes have, and the same set as from all boxes, for one profile and for all."""
    spec = FactorSpec(["a", "b", "c", "d"], [6, 5, 5, 4])
    rng = random.Random(3)
    rows = [(a, b, c, d, float(a > 2) + 2 * float(b > 1) + rng.gauss(0, 0.05)) for a in range(6) for b in range(5) for c in range(5) for d in range(4) if rng.random() < 0.8]
    cells = C.cell_table(spec, spark.createDataFrame(rows, ["a", "b", "c", "d", "y"]))
    made = []
    plain = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label="table": made.append(plain(df, label)) or made[-1])
    boxes = P.box_moments(spec, cells)
    for profile, theta in ((15, 0.012), (None, 0.004)):
        made.clear()
        found = R.frontier_set(spec, cells, theta, 1e-3, profile)
        tables = [t for t in made if "_rest" in t.columns]
        deepest = tables[-1].count()
        want = R.exhaustive_set(spec, cells, theta, 1e-3, profile)
        assert R.set_difference(found, want).count() == 0 and 0 < want.count()
        assert R.set_difference(found, R.frontier_set(spec, cells, theta, 1e-3, profile, boxes=boxes)).count() == 0
        assert deepest < 0.2 * boxes.count()


def test_pools_are_connected_components(spark):
    spec = FactorSpec(["a", "b"], [5, 4])
    parts = P.enumerate_partitions(spark, spec, 3).where("cut_mask % 5 = 1")
    nodes = P.assign_pools(spec, parts)
    found = D.connected_components(nodes.withColumnRenamed("policy_id", "node"), D.surviving_edges(spec, parts), by=["cut_mask"])
    both = nodes.join(found.withColumnRenamed("node", "policy_id"), ["cut_mask", "policy_id"])
    per = both.groupBy("cut_mask", "pool_id").agg(F.count_distinct("component").alias("n"), F.min("policy_id").alias("low"), F.min("component").alias("c"))
    assert per.where("n <> 1 or low <> c").count() == 0


def test_components_of_a_star_and_of_groups(spark):
    """A node with most of the edges, groups that share node names, and an edge from a node to itself."""
    star = [(1, 0, k) for k in range(1, 4000)] + [(1, 5000 + k, 4999 + k) for k in range(1, 60)]
    other = [(2, 3999, 3998), (2, 7, 7), (2, 12, 3999)]
    edges = spark.createDataFrame(star + other, "g int, src long, dst long").repartition(5)
    nodes = spark.createDataFrame([(1, k) for k in (0, 3999, 5059, 6000)] + [(2, k) for k in (3999, 3998, 7, 12, 0)], "g int, node long")
    found = {(r.g, r.node): r.component for r in D.connected_components(nodes, edges, by=["g"]).collect()}
    assert found == {(1, 0): 0, (1, 3999): 0, (1, 5059): 5000, (1, 6000): 6000, (2, 3999): 12, (2, 3998): 12, (2, 7): 7, (2, 12): 12, (2, 0): 0}


def test_sorted_check_over_ranges(spark):
    rows = [("up", i, i // 3) for i in range(3000)] + [("late", i, i if i < 2999 else 5) for i in range(3000)] + [("one", 4, 4)] + [("down", 1, 2), ("down", 2, 1)] + [("early", i, 9 if i == 0 else i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(9)
    got = {r["g"]: r["is_sorted"] for r in D.sorted_check(df, "g", "at", F.col("v")).collect()}
    assert got == {"up": True, "late": False, "one": True, "down": False, "early": False}


def test_partition_sizes_without_listing(spark):
    spec = FactorSpec(["a", "b"], [5, 5])
    profiles = spark.createDataFrame([(p,) for p in range(4)], "profile_id int")
    got = {(r.profile_id, r.h): r.n_partitions for r in P.partition_sizes(spec, profiles).collect()}
    listed = {(r.profile_id, r.h): r.n_partitions for r in P.count_by_size(P.enumerate_partitions(spark, spec)).collect()}
    assert got == listed and {h: n for (p, h), n in got.items() if p == 3} == {1: 1, 2: 6, 3: 6, 4: 11, 6: 18, 8: 6, 9: 9, 12: 6, 16: 1}
    wide = FactorSpec([f"f{i}" for i in range(8)], [7] * 8)  # 40 cut positions
    counts = P.partition_sizes(wide, spark.range(1).select(F.lit(wide.full_profile).alias("profile_id")))
    assert counts.agg(F.sum("n_partitions")).first()[0] == 2**40


def test_predict_splits_a_heavy_cell(spark, monkeypatch):
    spec = FactorSpec(["a", "b"], [4, 3])
    rows = [(1, 1, float(i % 7), i) for i in range(900)] + [(a, b, float(a * b), 1000 + 10 * a + b) for a in range(1, 4) for b in range(1, 3)]
    obs = spark.createDataFrame(rows, "a int, b int, y double, id int").repartition(5)
    cells = C.cell_table(spec, obs)
    args = spec, obs, P.enumerate_partitions(spark, spec, 3), P.box_moments(spec, cells)
    sent = Counter((r.id, r.cut_mask, round(r.fitted, 9)) for r in P.predict(*args).collect())
    monkeypatch.setattr(P, "SENT_ROWS", 0)
    assert Counter((r.id, r.cut_mask, round(r.fitted, 9)) for r in P.predict(*args).collect()) == sent and len(sent) == 8 * len(rows)


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(5).shuffle(order)
    nodes = spark.createDataFrame([(i,) for i in range(n + 3)], ["node"])
    edges = spark.createDataFrame(list(zip(order, order[1:])), ["src", "dst"])
    found = {r.node: r.component for r in D.connected_components(nodes, edges).collect()}
    assert all(found[i] == 0 for i in range(n)) and all(found[i] == i for i in range(n, n + 3))


def test_edges_are_pairs_at_distance_one(spark):
    spec = FactorSpec(["a", "b", "c"], [3, 2, 4])
    cells = list(product(*map(range, spec.levels)))
    for within in (True, False):
        want = set()
        for x in cells:
            for y in cells:
                if x < y and sum(abs(a - b) for a, b in zip(x, y)) == 1 and (not within or [a > 0 for a in x] == [b > 0 for b in y]):
                    want.add((brute.policy_id(spec, x), brute.policy_id(spec, y)))
        got = {(r.src, r.dst) for r in D.lattice_edges(spark, spec, within).collect()}
        assert got == want


def test_dominance_matches_its_predicate(spark):
    spec = FactorSpec(["a", "b"], [4, 3])
    p = D.policies(spark, spec)
    x = p.select(F.col("policy_id").alias("x"), F.col("a").alias("xa"), F.col("b").alias("xb"))
    y = p.select(F.col("policy_id").alias("y"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    want = x.join(y, D.weakly_dominates([F.col("xa"), F.col("xb")], [F.col("ya"), F.col("yb")]))
    got = D.dominance(spark, spec)
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.x, r.y) for r in want.collect())


def _brute_models(sets, theta, budget):
    out = Counter()
    for combo in product(*sets.values()):
        q, h = sum(c[0] for c in combo), sum(c[1] for c in combo)
        if q <= theta and (budget is None or h <= budget):
            out[tuple(c[2] for c in combo)] += 1
    return out


@pytest.mark.parametrize("n_slots,sizes", [(1, [5]), (2, [4, 1]), (3, [1, 1, 1]), (5, [6, 3, 1, 4, 5]), (7, [3, 2, 4, 1, 2, 3, 2])])
def test_combine_against_product(spark, n_slots, sizes):
    rng = random.Random(n_slots)
    sets = {s: [(round(rng.random(), 3), rng.randint(1, 4), f"{s}:{k}") for k in range(n)] for s, n in enumerate(sizes)}
    rows = [(s, q, h, [name]) for s, items in sets.items() for q, h, name in items]
    items = spark.createDataFrame(rows, "slot int, q double, h long, members array<string>")
    floor = sum(min(q for q, _, _ in v) for v in sets.values())
    for theta, budget in ((floor + 0.7, None), (floor + 1.0, 2 * n_slots + 1), (floor - 0.01, None)):
        got = Counter(tuple(sorted(r.members)) for r in M.combine(items, n_slots, theta, budget).collect())
        assert got == _brute_models(sets, theta, budget)


def test_combine_with_a_heavy_band(spark):
    """A third of all rows share one loss; the salted join must not lose or repeat any pair."""
    left = [(0, 0.5 if k % 3 == 0 else k / 900, 1, [f"a{k}"]) for k in range(900)]
    right = [(1, 0.5 if k % 3 == 0 else k / 1200, 1, [f"b{k}"]) for k in range(1200)]
    items = spark.createDataFrame(left + right, "slot int, q double, h long, members array<string>")
    want = sum(1 for a in left for b in right if a[1] + b[1] <= 0.9)
    old = M.PAIRS_PER_SALT
    try:
        for M.PAIRS_PER_SALT in (10, 100_000, old):
            got = M.combine(items, 2, 0.9)
            assert got.count() == want
            assert got.select(F.concat_ws("|", F.array_sort("members"))).distinct().count() == want
    finally:
        M.PAIRS_PER_SALT = old


def test_combine_many_slots(spark):
    """2^14 slots, most of them with one item: nothing of their number reaches the driver or the plan."""
    n = 1 << 14
    open_slots = {5: [0.1, 0.2, 0.4], 77: [0.0, 0.3], 9000: [0.2, 0.25], n - 1: [0.5, 0.6, 0.7]}
    choices = F.expr("case id " + " ".join(f"when {k} then array({', '.join(f'{q}D' for q in v)})" for k, v in open_slots.items()) + " else array(0.0D) end")
    items = spark.range(n).select(F.col("id").cast("int").alias("slot"), F.posexplode(choices).alias("k", "q"))
    items = items.select("slot", "q", F.lit(1).cast("long").alias("h"), F.expr("if(q > 0 or slot in (5, 77, 9000, 16383), array(concat(slot, ':', k)), cast(array() as array<string>))").alias("members"))
    got = Counter(tuple(sorted(r.members)) for r in M.combine(items, n, 1.21).select("members").collect())
    want = Counter(tuple(sorted(f"{s}:{k}" for s, k in zip(open_slots, combo))) for combo in product(*[range(len(v)) for v in open_slots.values()])
                   if sum(open_slots[s][k] for s, k in zip(open_slots, combo)) <= 1.21)
    assert got == want and len(want) > 10


@pytest.mark.parametrize("n_slots,sizes", [(1, [5]), (2, [4, 3]), (5, [6, 3, 1, 4, 5]), (7, [3, 2, 4, 1, 2, 3, 2])])
def test_usable_items_against_product(spark, n_slots, sizes):
    rng = random.Random(40 + n_slots)
    sets = {s: [(round(rng.random(), 3), rng.randint(0, 4), f"{s}:{k}") for k in range(n)] for s, n in enumerate(sizes)}
    items = spark.createDataFrame([(3 * s + 1, q, h, name) for s, v in sets.items() for q, h, name in v], "profile_id int, q double, h long, name string")
    floor = sum(min(q for q, _, _ in v) for v in sets.values())
    for theta, budget in ((floor + 0.3, None), (floor + 0.6, 2 * n_slots), (floor + 0.6, n_slots), (floor - 0.01, 50), (floor + 0.2, None)):
        used = {name for combo in _brute_models(sets, theta, budget) for name in combo}
        assert {r["name"] for r in M.usable_items(items, n_slots, theta, budget).collect()} == used
    assert M.usable_items(items, n_slots + 1, floor + 9, None).count() == M.usable_items(items, n_slots + 1, floor + 9, 99).count() == 0


def test_models_without_data_in_some_profiles(spark):
    spec = FactorSpec(["a", "b"], [4, 3])
    obs, rows = random_obs(spark, spec, 200, seed=9)
    obs, rows = obs.where("a > 0"), [r for r in rows if r[0][0] > 0]
    cells = C.cell_table(spec, obs)
    sets = {p: [(*brute.loss(spec, rows, p, m, 0.05, len(rows)), f"{p}:{m}") for m in brute.masks_of(spec, p)] for p in (2, 3)}
    theta = sum(min(q for q, _, _ in v) for v in sets.values()) * 1.1
    want = _brute_models(sets, theta, 6)
    got = M.near_optimal_models(spec, cells, theta, 0.05, max_pools=6)
    assert {r.model_key for r in got.collect()} == {"|".join(k) for k in want}


def test_expanding_threshold_steps(spark):
    scored = spark.createDataFrame([(1.0, 1), (1.15, 2), (1.3, 3)], "q double, h int")
    theta, df = R.expanding_threshold(scored, 0.5, 0.1)
    assert df.count() >= 1 and abs(theta - 1.0) < 1e-9
    theta, df = R.expanding_threshold(scored, 0.95, 0.1, found=F.col("h") == 3)
    assert abs(theta - 1.25) < 1e-9 and df.count() == 2
    theta, _ = R.expanding_threshold(scored, 0.5, 0.1, found=F.col("h") == 2)
    assert abs(theta - 1.2) < 1e-9


def test_both_sides_of_the_plan_switches(spark, monkeypatch):
    """Hints and routes that depend on sizes change plans, never rows."""
    spec = FactorSpec(["a", "b", "c"], [4, 3, 3])
    obs, _ = random_obs(spark, spec, 300, seed=11)
    cells = C.cell_table(spec, obs)

    def results():
        scored = P.score_space(spec, cells, 0.01)
        front = R.frontier_set(spec, cells, 0.5, 0.01, spec.full_profile, boxes=P.box_moments(spec, cells))
        means = P.pool_means(spec, P.enumerate_partitions(spark, spec, 7).where("h <= 2"), P.box_moments(spec, cells))
        return (sorted((r.profile_id, r.cut_mask, r.h, round(r.q, 10)) for r in scored.collect()), sorted((r.cut_mask, round(r.q, 10)) for r in front.collect()),
                sorted((r.cut_mask, r.box_id, r.n, round(r.mean_y, 10)) for r in means.collect()))

    usual = results()
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    assert results() == usual
    monkeypatch.setattr(P, "LOOKUPS", 0)
    monkeypatch.setattr(P, "STAGE_ROWS", 10)
    assert results() == usual and all(usual)
