"""Cells, profiles and the lattice between them, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from poolwise.runtime import discard, materialize
from poolwise.spec import FactorSpec, unfold


def policies(spark: SparkSession, spec: FactorSpec) -> DataFrame:
    """All cells with their levels and profile (D1, D4): arithmetic on a range, no joins."""
    return (spark.range(spec.n_policies).withColumnRenamed("id", "policy_id")
            .select("policy_id", *spec.level_columns(), spec.profile_of_policy().alias("profile_id")))


def profiles(spark: SparkSession, spec: FactorSpec) -> DataFrame:
    """All activity patterns."""
    flags = [f"cast({spec.active_sql(i)} as int) as active_{n}" for i, n in enumerate(spec.names)]
    return spark.range(spec.n_profiles).selectExpr("cast(id as int) as profile_id").selectExpr("profile_id", *flags)


def encode(spec: FactorSpec, obs: DataFrame) -> DataFrame:
    """Cell and profile of every row."""
    return obs.withColumn("policy_id", spec.policy_id()).withColumn("profile_id", spec.profile_id())


def local_ids(spec: FactorSpec, policies_df: DataFrame) -> DataFrame:
    """Dense ids inside each profile, in cell order (D5), by mixed radix over the active factors.

    The row itself is the map back to global ids (D7).
    """
    df = policies_df.withColumn("local_id", F.lit(0).cast("long"))
    for i, r in enumerate(spec.levels):
        lev = spec.level_sql(i)
        df = df.withColumn("local_id", F.expr(f"if({lev} > 0, local_id * {r - 1} + {lev} - 1, local_id)"))
    return df


def subset_profile(spec: FactorSpec, obs: DataFrame, profile_id: int) -> DataFrame:
    """Rows of one profile, keeping only its active factors."""
    keep = [spec.names[i] for i in spec.active_factors(profile_id)]
    rest = [c for c in obs.columns if c not in spec.names]
    return obs.where(spec.profile_id() == profile_id).select(*keep, *rest)


def masked_spec(spec: FactorSpec, profile_id: int) -> FactorSpec:
    """The design restricted to a profile's active factors."""
    act = spec.active_factors(profile_id)
    return FactorSpec([spec.names[i] for i in act], [spec.levels[i] for i in act])


def to_global(local: DataFrame, id_map: DataFrame) -> DataFrame:
    """Replace (profile_id, local_id) by policy_id."""
    return local.join(id_map.select("profile_id", "local_id", "policy_id"), ["profile_id", "local_id"]).drop("local_id")


def without_factor(df: DataFrame, spec: FactorSpec, factor: str) -> DataFrame:
    """Drop one factor and key the remaining levels."""
    i = spec.names.index(factor)
    rest = FactorSpec([n for n in spec.names if n != factor],
                      [r for j, r in enumerate(spec.levels) if j != i])
    return df.withColumn("rest_id", rest.policy_id()).drop(factor)


def weakly_dominates(x: list[Column], y: list[Column]) -> Column:
    """Same activity and at least the level of ``y`` everywhere."""
    out = F.lit(True)
    for a, b in zip(x, y):
        out = out & (a >= b) & ((a > 0) == (b > 0))
    return out


def dominance(spark: SparkSession, spec: FactorSpec) -> DataFrame:
    """(policy_id, dominated_id) pairs in long form.

    The dominated cells of a cell are a box, so they are written down directly;
    no pair outside the relation is ever formed.
    """
    df = spark.range(spec.n_policies).withColumnRenamed("id", "policy_id")
    return dominated_cells(spec, df)


def dominated_cells(spec: FactorSpec, df: DataFrame, policy: str = "policy_id") -> DataFrame:
    """Add ``dominated_id``: one row per cell that ``policy`` dominates."""
    below = [f"sequence(least({lev}, 1) * {w}L, {lev} * {w}L, {w}L)" for lev, w in zip(spec.levels_sql(policy), spec.strides)]
    return unfold(df, below, "dominated_id")


def dummy_totals(spec: FactorSpec, cells: DataFrame) -> DataFrame:
    """Column totals of the dominance dummy matrix: rows and outcome per dummy.

    Works on cells; the rows-by-cells matrix is never formed.
    """
    return (dominated_cells(spec, cells.select("policy_id", "n", "sum_y"))
            .groupBy(F.col("dominated_id").alias("policy_id"))
            .agg(F.sum("n").alias("n"), F.sum("sum_y").alias("sum_y")))


def lattice_edges(spark: SparkSession, spec: FactorSpec, within_profile: bool = True) -> DataFrame:
    """Pairs of cells one level apart in one factor (D12), found by id offset."""
    low = 1 if within_profile else 0
    steps = [f"if({lev} between {low} and {r - 2}, named_struct('dst', src + {w}L, 'factor', {i}, 'lower_level', {lev}), null)"
             for i, (lev, r, w) in enumerate(zip(spec.levels_sql("src"), spec.levels, spec.strides))]
    return (spark.range(spec.n_policies).withColumnRenamed("id", "src")
            .selectExpr("src", f"inline(filter(array({', '.join(steps)}), s -> s is not null))")
            .withColumn("profile_id", spec.profile_of_policy("src")))


def surviving_edges(spec: FactorSpec, partitions: DataFrame) -> DataFrame:
    """Lattice edges that a partition keeps: no cut at their lower level.

    ``partitions`` has (profile_id, cut_mask).  Each partition writes down the
    cells of its profile and, per cell, the steps that are not cut.
    """
    cells = [f"if({spec.active_sql(i)}, sequence({w}L, {(r - 1) * w}L, {w}L), array(0L))"
             for i, (r, w) in enumerate(zip(spec.levels, spec.strides))]
    steps = [f"if({lev} between 1 and {r - 2} and (shiftright({spec.factor_mask_sql(i)}, {lev} - 1) & 1L) = 0, "
             f"named_struct('dst', src + {w}L, 'factor', {i}), null)"
             for i, (lev, r, w) in enumerate(zip(spec.levels_sql("src"), spec.levels, spec.strides)) if r > 2]
    return (unfold(partitions.select("profile_id", "cut_mask"), cells, "src")
            .selectExpr("profile_id", "cut_mask", "src", f"inline(filter(array({', '.join(steps)}), s -> s is not null))"))


def connected_components(nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Smallest node id reachable over undirected edges (D14), for edges given by the user.

    Large and small stars in turn: every node links its larger neighbours, then its smaller ones, to the smallest node it
    knows.  Depths shrink geometrically and edges never grow in number, so a chain of n takes about log n rounds.  Minima
    combine map-side and are written before the edges meet them, so a node with most of the edges is split like any
    skewed join.  Each round is written, the one before removed.
    """
    by = list(by)
    keyed = edges.select(*by, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct()
    keyed = materialize(keyed, "edges")
    marks = (F.count(F.lit(1)), F.bit_xor(F.xxhash64(*by, "a", "b")), F.sum(F.pmod(F.xxhash64("b", "a", *by), F.lit(1 << 31))))
    before = keyed.agg(*marks).first()
    while before[0]:
        both = keyed.union(keyed.select(*by, "b", "a"))
        low = materialize(both.groupBy(*by, "a").agg(F.min("b").alias("m")).select(*by, "a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, by + ["a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy(*by, "a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, by + ["a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least).distinct()
        small = materialize(small, "edges")
        discard(keyed, low, large, least)
        keyed, after = small, small.agg(*marks).first()
        if after == before:
            break
        before = after
    roots = keyed.groupBy(*by, F.col("a").alias("node")).agg(F.min("b").alias("_root"))
    return nodes.select(*by, "node").join(roots, by + ["node"], "left").select(*by, "node", F.coalesce("_root", "node").alias("component"))


def sorted_check(df: DataFrame, by: str, position: str, key: Column) -> DataFrame:
    """Whether the key ascends along ``position`` inside each group.

    Rows are dealt out by ranges of (group, position), so a group of any size is spread over tasks: each range checks its
    own rows, and of each range only its first and last key meet those of the next.
    """
    ranged = df.select(F.col(by), F.col(position).alias("_at"), key.alias("_key")).repartitionByRange(by, "_at")
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(by, "_range").orderBy("_at")
    own = (ranged.select(by, "_range", "_at", "_key", (F.col("_key") >= F.lag("_key").over(inside)).alias("_ok"))
           .groupBy(by, "_range").agg(F.bool_and(F.coalesce("_ok", F.lit(True))).alias("_ok"), F.min_by("_key", "_at").alias("_first"), F.max_by("_key", "_at").alias("_last")))
    across = Window.partitionBy(by).orderBy("_range")
    joined = own.select(by, (F.col("_ok") & F.coalesce(F.col("_first") >= F.lag("_last").over(across), F.lit(True))).alias("_ok"))
    return joined.groupBy(by).agg(F.bool_and("_ok").alias("is_sorted"))
