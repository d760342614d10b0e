"""Near-duplicate vectors: a navigable small-world graph per shard, every vector against every shard.

Equal vectors are one from the start, with the number of their copies, so a group of copies of any size costs one
node.  The others are dealt to shards by hash; each shard's graph is built in one task, which bounds a shard, and
audits itself: a sample of its vectors and one of the other shards' vectors are compared to all of the shard, and the
beam doubles until the samples' true pairs, none of them a vector with itself, are met (beyond a quarter of the shard
everything is compared).  Where the samples hold no pair, their nearest neighbours, which always exist, have to be met
instead.  Vectors then query every shard in blocks, whose bytes are about those of a graph.  Pairs found are verified by cosine in double precision, and their components are united.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different length
never meet.  Repeated vec_ids are rows of their own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwise.llm.graph import components
from poolwise.llm.hnsw import Graph
from poolwise.llm.scratch import Scratch

#: Vectors and bytes that one shard may hold (in expectation), and the fewest shards.
SHARD, SHARD_BYTES, SHARDS = 100_000, 256 << 20, 4
#: Bytes of the queries of one block: as a block meets each shard's graph once, graphs sent stay in proportion to queries sent.
BLOCK_BYTES = 64 << 20
#: Vectors of a shard that its audit queries, as many of other shards (in expectation), and the share of their true pairs that has to be met.
AUDIT, RECALL = 1024, 0.97
#: What single-precision search may be off by.
SLACK = 1e-4


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return (raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))).astype(np.float32)


def _build(least: float, audit: int, recall: float):
    def build(table: pa.Table) -> pa.Table:
        inside = table["inside"].to_numpy(zero_copy_only=False)
        asking, table = table.filter(pa.array(~inside)), table.filter(pa.array(inside))
        if not len(table):
            return pa.table({"dim": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "recall": pa.array([], pa.float64()),
                             "beam": pa.array([], pa.int32()), "graph": pa.array([], pa.binary())})
        keys = table["rep"].to_numpy()
        order = np.argsort(keys * np.int64(0x5851F42D4C957F2D) ^ (keys >> 17), kind="stable")  # fixed, and unlike the ids
        raw = _matrix(table["vector"])[order]
        graph = Graph(_unit(raw))
        reached = graph.audit(least - SLACK, audit, recall, _unit(_matrix(asking["vector"])) if len(asking) else None)
        blob = pickle.dumps((keys[order], raw, graph.levels, graph.beam))
        return pa.table({"dim": pa.array([raw.shape[1]], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                         "recall": pa.array([reached]), "beam": pa.array([graph.beam], pa.int32()), "graph": pa.array([blob], pa.large_binary()).cast(pa.binary())})
    return build


def _query(least: float):
    def query(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(queries) or not len(graphs):
            return none
        keys, raw, levels, beam = pickle.loads(graphs["graph"][0].as_py())
        graph = Graph.__new__(Graph)
        graph.unit, graph.levels, graph.beam = _unit(raw), levels, beam
        mine, own = queries["rep"].to_numpy(), _matrix(queries["vector"])
        query, node = graph.similar(_unit(own), least - SLACK)
        other = keys[node] != mine[query]
        query, node = query[other], node[other]
        out = []
        for begin in range(0, len(query), 1 << 16):
            q, v = own[query[begin:begin + (1 << 16)]], raw[node[begin:begin + (1 << 16)]]
            out.append((q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))) >= least)
        exact = np.concatenate(out) if out else np.zeros(0, dtype=bool)
        a, b = mine[query[exact]], keys[node[exact]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
    return query


def usable(vector: Column) -> Column:
    """Not null, not zero, and of finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def vector_components(vectors: DataFrame, least: float = 0.95, shard: int = SHARD, shards: int = SHARDS, audit: int = AUDIT, recall: float = RECALL,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row; the pairs behind them are all verified."""
    spark = vectors.sparkSession
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = ids.groupBy("vec_id").count().where("count > 1 OR vec_id IS NULL").limit(1).count()
    ids = ids.withColumn("key", F.xxhash64("vec_id", "vector") if odd else F.col("vec_id"))
    good = F.coalesce(usable(F.col("vector")), F.lit(False))
    with Scratch(spark) as scratch:
        whole = ids.where(good).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # one zero
        reps = scratch.write(whole.groupBy("vector").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "reps")
        total = reps.count()
        width = 8 * (reps.agg(F.max(F.size("vector"))).first()[0] or 1)
        parts, blocks = max(shards, -(-total // min(shard, SHARD_BYTES // (width + 256) + 1))), max(1, -(-total * width // block_bytes))
        nodes = reps.select("rep", "vector", F.size("vector").alias("dim"))
        dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int"))
        share = min(1.0, audit / max(1, total))
        asking = dealt.where(F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30)))
        asking = asking.withColumn("home", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("shard <> home").drop("home")
        grouped = dealt.withColumn("inside", F.lit(True)).unionByName(asking.withColumn("inside", F.lit(False)))
        graphs = grouped.groupBy("dim", "shard").applyInArrow(_build(least, audit, recall), "dim int, shard int, recall double, beam int, graph binary")
        graphs = scratch.write(graphs, "graphs")
        asked = nodes.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        answers = graphs.select("dim", "shard", "graph").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["dim", "shard", "block"]
        pairs = asked.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(_query(least), "a long, b long").distinct()
        pairs = scratch.write(pairs, "pairs")
        roots = components(pairs, scratch)
        both = pairs.union(pairs.select(F.col("b"), F.col("a")))
        degree = both.join(reps.select(F.col("rep").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
        named = reps.join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        named = scratch.write(named.select("vector", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named")
        smallest = scratch.write(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
        named = scratch.write(named.join(smallest, "root").select("vector", "n_links", "component_id"), "united")
        linked = whole.select("vec_id", "vector").join(named, "vector").select("vec_id", "n_links", "component_id")
        alone = ids.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = linked.union(alone)
        return scratch.keep(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vector-dups")
