"""Sets of near-optimal partitions of a profile: q <= theta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.running import running
from poolwise.operators.partitions import centred, deeper_boxes, score_space
from poolwise.runtime import bounded, materialize, scalar, spread
from poolwise.spec import FactorSpec

# Losses are summed in another order than thresholds; whatever prunes before the last filter allows for this much.
TOLERANCE = 1e-12
# Cuts decided per frontier round: many at first, few once there can be many nodes.
FIRST_BITS, LATER_BITS, FEW_NODES = 4, 2, 2**9
# The frontier's plan grows by one join per round; write it out this often.
ROUNDS_PER_CUT = 6


def exhaustive_set(spec: FactorSpec, cells: DataFrame, theta: float, reg: float,
                   profile_id: int | None = None, max_pools: int | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """Every partition with q <= theta, by scoring the whole space.

    The pool budget is applied before any box is looked up.
    """
    return score_space(spec, cells, reg, profile_id, max_pools, boxes).where(F.col("q") <= theta)


def frontier_set(spec: FactorSpec, cells: DataFrame, theta: float | Column, reg: float,
                 profile_id: int | None = None, max_pools: int | None = None,
                 theta_by_profile: DataFrame | None = None, boxes: DataFrame | None = None, split: DataFrame | None = None) -> DataFrame:
    """The same set without scoring the whole space.

    ``boxes`` and ``split`` (profile_id and error with every cut made) replace the errors around means by those of another fit.

    A node fixes the cuts below some bit and leaves the others open.  Its bound
    is the error with all open cuts made, plus the penalty with none made.  A
    round decides the next few bits of a factor: the child that makes all cuts
    keeps the error of its parent, only children that merge are looked up in a
    table of box errors.  Children are hashed before they unfold: one shuffle of
    small rows a round.

    Boxes are made on demand, a factor deeper each time: a partial box is an
    interval per decided factor, its moments are kept per level of the open ones,
    and only partial boxes that a live node has are taken to the next factor.  With
    ``boxes`` handed in, whole boxes are looked up instead.
    """
    total = int(scalar(cells.agg(F.sum("n"))))
    start = split if split is not None else cells.groupBy("profile_id").agg(F.sum("ssw").alias("sse"))
    if profile_id is not None:
        start = start.where(F.col("profile_id") == profile_id)
    if theta_by_profile is not None:
        start = start.join(theta_by_profile.select("profile_id", "theta"), "profile_id")
    else:
        start = start.withColumn("theta", F.lit(theta) if not isinstance(theta, Column) else theta)
    nodes = start.selectExpr("profile_id", f"{spec.full_mask_sql()} as cut_mask", "cast(theta as double) as theta", "sse")
    penalty = f"{float(reg)!r}D * h"
    budget = "true" if max_pools is None else f"h <= {max_pools}"
    if boxes is None:
        nodes = materialize(nodes.where(f"sse / {total} <= theta + {TOLERANCE!r}D"), "frontier")
        moments = centred(cells).join(nodes.select("profile_id"), "profile_id", "left_semi").withColumnRenamed("policy_id", "_rest").withColumn("box_id", F.lit(0).cast("long"))
        for i in range(spec.m):
            moments = deeper_boxes(spec, moments, i)
            if not spec.bits[i]:
                continue
            moments = materialize(moments, "moments")
            errors = moments.groupBy("profile_id", "box_id").agg(F.sum(F.expr("greatest(_ss - try_divide(_s * _s, n), 0.0D) + ssw")).alias("_box_sse"))
            for j, width in [(j, width) for k, j, width in _rounds(spec) if k == i]:
                nodes = _decided(spec, nodes, errors, ["profile_id", "box_id"], i, j, width, total, penalty, budget, i + 1)
            nodes = materialize(nodes, "frontier")
            if i + 1 < spec.m:
                live = spec.mask_boxes(nodes.select("profile_id", "cut_mask"), factors=i + 1).select("profile_id", "box_id").distinct()
                moments = moments.join(live, ["profile_id", "box_id"], "left_semi")
    else:
        side = bounded(boxes.select("box_id", F.col("sse").alias("_box_sse")), spec.n_boxes)
        rounds = _rounds(spec)
        for turn, (i, j, width) in enumerate(rounds):
            nodes = _decided(spec, nodes, side, ["box_id"], i, j, width, total, penalty, budget, spec.m)
            if (turn + 1) % ROUNDS_PER_CUT == 0 and turn + 1 < len(rounds):
                nodes = materialize(nodes, "frontier")
    return (nodes.selectExpr("*", f"{spec.pool_count_sql()} as h").where(budget)
            .selectExpr("profile_id", "cut_mask", "h", "sse", f"sse / {total} + {penalty} as q", "theta")
            .where("q <= theta").drop("theta"))


def _decided(spec: FactorSpec, nodes: DataFrame, errors: DataFrame, key: list[str], i: int, j: int, width: int, total: int,
             penalty: str, budget: str, factors: int) -> DataFrame:
    """The children of the nodes that decide ``width`` cuts of factor ``i`` from ``j`` on and stay within the threshold.

    ``errors`` has _box_sse by ``key`` for boxes of the first ``factors`` factors.
    """
    first = spec.offsets[i] + j
    decided = f"(cut_mask & {(1 << first + width) - 1}L)"
    drops = ", ".join(f"{drop << first}L" for drop in range(1 << width))
    children = (nodes.selectExpr("*", f"explode(if({spec.active_sql(i)}, array({drops}), array(0L))) as _drop")
                .selectExpr("profile_id", "cut_mask - _drop as cut_mask", "theta", "sse", "_drop > 0 as _merge")
                .selectExpr("*", f"{spec.pool_count_sql(decided)} as h")
                .where(f"{budget} and {penalty} <= theta + {TOLERANCE!r}D"))
    unfolded = spec.mask_boxes(spread(children, "profile_id", "cut_mask"), only="_merge", factors=factors)
    return (unfolded.join(errors, key, "left")
            .groupBy("profile_id", "cut_mask", "theta", "h", "_merge", "sse").agg(F.sum("_box_sse").alias("_own"))
            .selectExpr("profile_id", "cut_mask", "theta", "if(_merge, coalesce(_own, 0.0D), sse) as sse", "h")
            .where(f"sse / {total} + {penalty} <= theta + {TOLERANCE!r}D").drop("h"))


def _rounds(spec: FactorSpec) -> list[tuple[int, int, int]]:
    """(factor, first position, positions) per round; after b decided bits there are at most 2^b nodes per profile."""
    out, decided = [], 0
    for i in range(spec.m):
        j = 0
        while j < spec.bits[i]:
            width = min(FIRST_BITS if 2**decided < FEW_NODES else LATER_BITS, spec.bits[i] - j)
            out.append((i, j, width))
            j, decided = j + width, decided + width
    return out


def batch_scores(spec: FactorSpec, cells: DataFrame, keys: list[str], reg: float, profile_id: int | None = None) -> DataFrame:
    """Scores for many outcomes, configurations or strata in one job.

    ``cells`` carries the key columns.  N is the row count of the respective
    combination.
    """
    return score_space(spec, cells, reg, profile_id, by=keys)


def unique_partitions(*sets: DataFrame) -> DataFrame:
    """Union of partition tables without repeats."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["profile_id", "cut_mask"])


def members_of(partitions: DataFrame, reference: DataFrame) -> DataFrame:
    """Partitions that another set holds as well."""
    return partitions.join(reference.select("profile_id", "cut_mask"), ["profile_id", "cut_mask"], "left_semi")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Partitions found by only one of two searches; empty means equal sets."""
    cols = ["profile_id", "cut_mask"]
    left = a.select(*cols).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
    right = b.select(*cols).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    return (left.unionByName(right).groupBy(*cols).agg(F.sum("_a").alias("in_a"), F.sum("_b").alias("in_b"))
            .where(F.col("in_a") != F.col("in_b")))


def order_by_loss(scored: DataFrame, by: list[str] = ("profile_id",), digits: int = 12) -> DataFrame:
    """Rank inside each profile by loss, ties by mask (R14).  Hand in a written table: ranking reads it twice."""
    keyed = scored.withColumn("_key", F.round("q", digits))
    return running(keyed, list(by), ["_key", "cut_mask"], position="position").drop("_key")


def theta_curve(scored: DataFrame, multipliers: list[float], by: list[str] = ()) -> DataFrame:
    """Set sizes for thresholds that are multiples of the best loss (R25): one pass over the scores.

    A partition belongs to every threshold from its own ratio on, so the few
    thresholds are unrolled per row instead of joined.
    """
    best = scored.agg(F.min("q")).scalar()
    ms = sorted(multipliers)
    hit = F.filter(F.array(*[F.lit(float(m)) for m in ms]), lambda m: F.col("q") <= m * F.col("_best"))
    return (scored.withColumn("_best", best).withColumn("multiplier", F.explode(hit))
            .groupBy(*by, "multiplier").agg(F.count("*").alias("n_partitions"), F.max("h").alias("max_h")))


def expanding_threshold(scored: DataFrame, theta: float, step: float = 0.1, factor: float = 1.2,
                        found: Column | None = None) -> tuple[float, DataFrame]:
    """Raise theta until a target is in the set or theta reaches ``factor`` times the best loss.

    Losses are computed once; the thresholds tried are the arithmetic steps
    theta, theta + step, ..., so the stopping one follows from two minima.
    """
    if step <= 0:
        raise ValueError(f"the step must be positive, not {step}")
    scored = materialize(scored, "scores")
    target = F.col("q") if found is None else F.when(found, F.col("q"))
    best, hit = scored.agg(F.min("q"), F.min(target)).first()
    if best is None:
        return theta, scored
    steps = 0
    while True:
        value = theta + steps * step
        reached = hit is not None and hit <= value
        limit = factor * best if best <= value else factor * value
        if reached or value >= limit:
            return value, scored.where(F.col("q") <= value)
        steps += 1
