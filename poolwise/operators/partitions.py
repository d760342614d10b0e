"""Partitions as cut masks: enumeration, pools and their losses.

A partition of a profile is a product of factor segmentations, and each of its
pools is a box.  The squared error of a box does not depend on the partition it
is met in, so box errors are computed once (``box_moments``) and every
partition is scored by an equi-join on ``box_id`` over exactly the boxes it
has.  Nothing of size partitions x cells is formed.
"""

from __future__ import annotations

from math import comb, prod

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwise.runtime import bounded, spread
from poolwise.spec import FactorSpec

# Spaces with more box lookups than this are summed factor by factor instead.
LOOKUPS = 2_000_000
# Fitted cells, some 30 bytes each, that are sent to all facts.
SENT_ROWS = 500_000
# Sum up the boxes found so far when the next expansion would exceed this many rows.
STAGE_ROWS = 2_000_000


def enumerate_partitions(spark: SparkSession, spec: FactorSpec, profile_id: int | None = None) -> DataFrame:
    """(profile_id, cut_mask, h) of every partition of one profile, or of all profiles.

    One distributed range: per factor the digit says "inactive" or which cuts
    are made, so no profile list has to be joined in.
    """
    sizes, state = [], []
    for i in range(spec.m):
        if profile_id is None:
            sizes.append(1 + (1 << spec.bits[i]))
        elif i in spec.active_factors(profile_id):
            sizes.append(1 << spec.bits[i])
        else:
            sizes.append(1)
    total = 1
    for s in sizes:
        total *= s
    weight, profile, mask = 1, [], []
    for i in reversed(range(spec.m)):
        digit = f"((id div {weight}L) % {sizes[i]}L)"
        weight *= sizes[i]
        if profile_id is None:
            profile.append(f"if({digit} > 0, {spec.profile_bit(i)}, 0)")
            digit = f"greatest({digit} - 1, 0L)"
        mask.append(f"{digit} * {1 << spec.offsets[i]}L")
    profile = " + ".join(profile) if profile_id is None else str(profile_id)
    return (spark.range(total).selectExpr(f"cast({profile} as int) as profile_id", f"{' + '.join(mask)} as cut_mask")
            .selectExpr("profile_id", "cut_mask", f"{spec.pool_count_sql()} as h"))


def maximal_split(spec: FactorSpec, factor: int, start: int, mask: str = "cut_mask") -> str:
    """SQL: all cuts of a factor from a position on, other cuts as they are."""
    extra = (spec.full_mask(factor) >> start << start) << spec.offsets[factor]
    return f"({mask} | {extra}L)"


def minimal_split(spec: FactorSpec, factor: int, start: int, mask: str = "cut_mask") -> str:
    """SQL: no cut of a factor from a position on, i.e. the fewest pools below that node."""
    drop = (spec.full_mask(factor) >> start << start) << spec.offsets[factor]
    return f"({mask} & {((1 << 62) - 1) & ~drop}L)"


def assign_pools(spec: FactorSpec, partitions: DataFrame) -> DataFrame:
    """Pool of every cell under every given partition.

    The cells of a profile are written down by arithmetic, so this is a narrow
    map over the partitions; use it for chosen partitions, not to score spaces.
    """
    df = spec.box_policies(spec.mask_boxes(partitions))
    return df.withColumn("pool_id", F.expr(spec.pool_sql(spec.levels_sql())))


def box_moments(spec: FactorSpec, cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, mean and squared error of every box that holds data.

    Outcomes are centred before they are squared, so the squares do not cancel.
    """
    by = list(by)
    centre = cells.agg(F.sum("sum_y") / F.sum("n")).scalar()
    sums = ["n", "sum_y", "_s", "_ss", "ssw"]
    df = (cells.withColumn("_d", F.col("mean_y") - centre)
          .selectExpr(*by, "policy_id", "n", "sum_y", "ssw", "n * _d as _s", "n * _d * _d as _ss"))
    return _finish_boxes(sum_over_boxes(spec, df, sums, by))


def centred(cells: DataFrame) -> DataFrame:
    """Additive moments of each cell around the mean of all rows."""
    centre = cells.agg(F.sum("sum_y") / F.sum("n")).scalar()
    return (cells.withColumn("_d", F.col("mean_y") - centre)
            .selectExpr("profile_id", "policy_id", "n", "ssw", "n * _d as _s", "n * _d * _d as _ss"))


def deeper_boxes(spec: FactorSpec, moments: DataFrame, i: int) -> DataFrame:
    """Moments of partial boxes with intervals of the factors up to ``i``, from those with intervals of the factors before.

    ``box_id`` names the intervals, ``_rest`` the levels of the factors that are still open.
    """
    w, sums = spec.strides[i], ["n", "_s", "_ss", "ssw"]
    spread_out = moments.selectExpr("profile_id", *sums, f"_rest % {w}L as _rest", "box_id", f"explode({spec.covering_sql(i, f'_rest div {w}L')}) as _c")
    return spread_out.groupBy("profile_id", (F.col("box_id") + F.col("_c")).alias("box_id"), "_rest").agg(*[F.sum(c).alias(c) for c in sums])


def sum_over_boxes(spec: FactorSpec, df: DataFrame, sums: list[str], by: list[str] = ()) -> DataFrame:
    """Sum additive cell columns over every box that holds data.

    Cells are spread over the intervals that cover them, a few factors at a
    time with a sum in between: summing early keeps each expansion near the
    size of its result instead of cells times all interval products.
    """
    by = list(by)
    rows = spec.n_policies
    df = spread(df, *by, "policy_id", rows=rows * _mean_cover(spec, 0)).selectExpr(*by, *sums, "policy_id as _rest", "0L as box_id")
    for i, w in enumerate(spec.strides):
        df = (df.selectExpr(*by, *sums, f"_rest % {w}L as _rest", "box_id", f"explode({spec.covering_sql(i, f'_rest div {w}L')}) as _c")
              .selectExpr(*by, *sums, "_rest", "box_id + _c as box_id"))
        rows *= _mean_cover(spec, i)
        if i + 1 == spec.m or rows * _mean_cover(spec, i + 1) > STAGE_ROWS:
            df = df.groupBy(*by, "_rest", "box_id").agg(*[F.sum(c).alias(c) for c in sums])
            rows = prod(1 + (r - 1) * r // 2 for r in spec.levels[:i + 1]) * prod(spec.levels[i + 1:])
    return df.drop("_rest")


def _mean_cover(spec: FactorSpec, i: int) -> int:
    """Intervals that hold a level of the factor, on average."""
    r = spec.levels[i]
    return max(1, r * (r + 1) // 6)


def needed_box_moments(spec: FactorSpec, cells: DataFrame, boxes: DataFrame, by: list[str] = ()) -> DataFrame:
    """The same moments for the given (by, box_id) only: for designs with too many boxes to list.

    A box writes down its cells and meets them by key, so the work is the sum
    of the box volumes.
    """
    by = list(by)
    centre = cells.agg(F.sum("sum_y") / F.sum("n")).scalar()
    moments = (cells.withColumn("_d", F.col("mean_y") - centre)
               .selectExpr(*by, "policy_id", "n", "sum_y", "ssw", "n * _d as _s", "n * _d * _d as _ss"))
    unfolded = spec.box_policies(boxes.select(*by, "box_id").distinct())
    df = (unfolded.join(bounded(moments, spec.n_policies, by), by + ["policy_id"])
          .groupBy(*by, "box_id").agg(*[F.sum(c).alias(c) for c in ["n", "sum_y", "_s", "_ss", "ssw"]]))
    return _finish_boxes(df)


def _finish_boxes(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c not in ("_s", "_ss", "ssw")]
    return df.selectExpr(*keep, "try_divide(sum_y, n) as mean_y", "greatest(_ss - try_divide(_s * _s, n), 0.0D) + ssw as sse")


def partition_errors(spec: FactorSpec, partitions: DataFrame, boxes: DataFrame, by: list[str] = (),
                     keep: list[str] = ("h",)) -> DataFrame:
    """Squared error of each partition: the sum over its boxes (R9 without the penalty).

    Partitions are hashed before they unfold, so all boxes of one are summed
    where they were written down; with a broadcast box table this is the only
    shuffle.  Boxes without data add nothing.
    """
    by = list(by)
    unfolded = spec.mask_boxes(spread(partitions, *by, "profile_id", "cut_mask"))
    side = bounded(boxes.select(*by, "box_id", "sse"), spec.n_boxes, by)
    return (unfolded.join(side, by + ["box_id"], "left")
            .groupBy(*by, "profile_id", "cut_mask", *keep)
            .agg(F.coalesce(F.sum("sse"), F.lit(0.0)).alias("sse")))


def space_lookups(spec: FactorSpec, profile_id: int | None = None) -> int:
    """Boxes of all partitions of a space, i.e. the cost of looking them all up."""
    out = 1
    for i, r in enumerate(spec.levels):
        active = r * (1 << (r - 2)) // 2 if r > 2 else 1
        if profile_id is None:
            out *= 1 + active
        elif i in spec.active_factors(profile_id):
            out *= active
    return out


def space_errors(spec: FactorSpec, boxes: DataFrame, by: list[str] = (), profile_id: int | None = None,
                 max_pools: int | None = None) -> DataFrame:
    """Squared error of every partition of all observed profiles, or of one, without looking boxes up.

    The error of a partition is a sum over the product of its factors'
    segments, so factors can be summed out one after the other: an interval of
    factor i adds its rows to every cut mask of that factor that has it as a
    segment.  Each step is an expansion and a partial aggregation, there is no
    join, and rows shrink towards one per partition.
    """
    by = list(by)
    profile = " + ".join(f"if({spec.box_code_sql(i)} > 0, {spec.profile_bit(i)}, 0)" for i in range(spec.m))
    df = spread(boxes, *by, "box_id", rows=spec.n_boxes).selectExpr(*by, f"cast({profile} as int) as profile_id", "box_id as _rest", "0L as cut_mask", "sse")
    intervals, shapes = [1 + (r - 1) * r // 2 for r in spec.levels], [1 + (1 << r - 2) for r in spec.levels]
    if profile_id is not None:
        df = df.where(F.col("profile_id") == profile_id)
        active = spec.active_factors(profile_id)
        intervals = [k - 1 if i in active else 1 for i, k in enumerate(intervals)]
        shapes = [k - 1 if i in active else 1 for i, k in enumerate(shapes)]
    rows = prod(intervals)
    for i, w in enumerate(spec.box_strides):
        df = (df.selectExpr(*by, "profile_id", f"_rest % {w}L as _rest", "cut_mask", "sse", f"explode({spec.masks_with_segment_sql(i, f'(_rest div {w}L)')}) as _m")
              .selectExpr(*by, "profile_id", "_rest", "cut_mask + _m as cut_mask", "sse"))
        rows = rows * spec.levels[i] // 2
        if i + 1 == spec.m or rows * spec.levels[i + 1] // 2 > STAGE_ROWS:
            df = df.groupBy(*by, "profile_id", "_rest", "cut_mask").agg(F.sum("sse").alias("sse"))
            if max_pools is not None:
                df = df.where(f"{spec.pool_count_sql()} <= {max_pools}")
            rows = prod(shapes[:i + 1]) * prod(intervals[i + 1:])
    return df.selectExpr(*by, "profile_id", "cut_mask", f"{spec.pool_count_sql()} as h", "sse")


def score_space(spec: FactorSpec, cells: DataFrame, reg: float, profile_id: int | None = None, max_pools: int | None = None,
                boxes: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Scores of the whole space of one profile, or of all observed ones (R2 with R9).

    A profile without cells has no scores, whichever way the space is scored.
    Small spaces write their partitions down and look the boxes up in one
    shuffle; large ones are summed factor by factor.
    """
    by = list(by)
    if boxes is None:
        boxes = box_moments(spec, cells if profile_id is None else cells.where(F.col("profile_id") == profile_id), by)
    if space_lookups(spec, profile_id) <= LOOKUPS and not by:
        space = enumerate_partitions(cells.sparkSession, spec, profile_id)
        if profile_id is None:
            space = space.join(cells.select("profile_id").distinct(), "profile_id", "left_semi")
        else:
            space = space.where(cells.where(F.col("profile_id") == profile_id).agg(F.count("*") > 0).scalar())
        if max_pools is not None:
            space = space.where(F.col("h") <= max_pools)
        return score_partitions(spec, space, cells, reg, boxes=boxes)
    return with_loss(space_errors(spec, boxes, by, profile_id, max_pools), cells, reg, by)


def score_partitions(spec: FactorSpec, partitions: DataFrame, cells: DataFrame, reg: float,
                     by: list[str] = (), boxes: DataFrame | None = None) -> DataFrame:
    """Penalised loss q = sse / N + reg * h of the given partitions.

    N counts all rows of ``cells`` (per ``by`` group), whatever profile the
    partition belongs to.
    """
    by = list(by)
    if "h" not in partitions.columns:
        partitions = partitions.withColumn("h", spec.pool_count())
    boxes = boxes if boxes is not None else box_moments(spec, cells, by)
    return with_loss(partition_errors(spec, partitions, boxes, by), cells, reg, by)


def with_loss(err: DataFrame, cells: DataFrame, reg: float, by: list[str] = ()) -> DataFrame:
    """Add q to rows with sse and h."""
    by = list(by)
    if by:
        err = err.join(cells.groupBy(*by).agg(F.sum("n").alias("_total")), by)
    else:
        err = err.withColumn("_total", cells.agg(F.sum("n")).scalar())
    return err.selectExpr(*by, "profile_id", "cut_mask", "h", "sse", f"sse / _total + {float(reg)!r}D * h as q")


def lower_bound(spec: FactorSpec, partitions: DataFrame, cells: DataFrame, factor: int, position: int, reg: float,
                boxes: DataFrame | None = None) -> DataFrame:
    """Bound of a search node (R8, and L3 with boxes that hold lines): error of the maximal split plus the penalty of the fewest pools.

    The maximal split cuts ``factor`` from ``position`` on; the fewest pools
    merge it again after ``position``.
    """
    split = maximal_split(spec, factor, position)
    few = minimal_split(spec, factor, position + 1, split)
    nodes = partitions.selectExpr("profile_id", "cut_mask as node_mask", f"{split} as cut_mask", f"{spec.pool_count_sql(few)} as h_min")
    err = partition_errors(spec, nodes, boxes if boxes is not None else box_moments(spec, cells), keep=["node_mask", "h_min"])
    total = cells.agg(F.sum("n")).scalar()
    return (err.withColumn("_total", total)
            .select("profile_id", F.col("node_mask").alias("cut_mask"), "h_min",
                    (F.col("sse") / F.col("_total") + F.lit(float(reg)) * F.col("h_min")).alias("bound")))


def pool_means(spec: FactorSpec, partitions: DataFrame, boxes: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per pool with its row count, outcome sum and mean; zeros without data."""
    by = list(by)
    side = bounded(boxes.select(*by, "box_id", "n", "sum_y", "mean_y"), spec.n_boxes, by)
    return spec.mask_boxes(partitions).join(side, by + ["box_id"], "left").fillna(0, ["n", "sum_y", "mean_y"])


def predict(spec: FactorSpec, rows: DataFrame, partitions: DataFrame, boxes: DataFrame, salts: int = 16) -> DataFrame:
    """Fitted pool mean for each row under each chosen partition of its profile.

    Chosen partitions become a (cell, fitted) table first, of design size; the facts meet it by cell and are never
    expanded by pools.  Where its bound, cells times partitions, is small it is sent to the facts; beyond, facts are
    dealt over ``salts`` copies of it, so a cell that holds a third of them is split.
    """
    fitted = (assign_pools(spec, partitions)
              .join(bounded(boxes.select("box_id", F.col("mean_y").alias("fitted")), spec.n_boxes), "box_id", "left")
              .fillna(0.0, ["fitted"])
              .select("policy_id", "cut_mask", "pool_id", "fitted"))
    facts = rows.withColumn("policy_id", spec.policy_id())
    if spec.n_policies * partitions.count() <= SENT_ROWS:
        return facts.join(F.broadcast(fitted), "policy_id")
    facts = facts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return facts.join(fitted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["policy_id", "_salt"]).drop("_salt")


def count_by_size(scored: DataFrame) -> DataFrame:
    """Number of partitions with each pool count (R12), of a scored space."""
    return scored.groupBy("profile_id", "h").agg(F.count("*").alias("n_partitions"))


def partition_sizes(spec: FactorSpec, profiles: DataFrame) -> DataFrame:
    """The same for whole spaces of any size, without listing a partition: profile_id, h and n_partitions.

    A factor with b cut positions has C(b, k) ways to make k + 1 segments, and pool counts multiply, so the counts of
    the factors are convolved one after the other.  Rows are pool counts, not partitions.
    """
    df = profiles.select("profile_id").distinct().selectExpr("profile_id", "1L as h", "cast(1 as decimal(38, 0)) as n_partitions")
    for i in range(spec.m):
        if spec.bits[i]:
            ways = ", ".join(f"named_struct('_k', {k + 1}L, '_ways', cast({comb(spec.bits[i], k)} as decimal(19, 0)))" for k in range(spec.bits[i] + 1))
            df = (df.selectExpr("*", f"inline(if({spec.active_sql(i)}, array({ways}), array(named_struct('_k', 1L, '_ways', cast(1 as decimal(19, 0))))))")
                  .selectExpr("profile_id", "h * _k as h", "cast(n_partitions * _ways as decimal(38, 0)) as n_partitions")
                  .groupBy("profile_id", "h").agg(F.sum("n_partitions").cast("decimal(38, 0)").alias("n_partitions")))
    return df.withColumn("n_partitions", F.col("n_partitions").cast("long"))
