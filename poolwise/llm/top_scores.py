"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in blocks of queries that are small enough to send to all tasks.  No scores
are stored or sorted.  Instead each round counts them:

1. a task scores its rows and counts the scores of each query into buckets of equal width over the range that still
   holds the query's k-th best value; only its buckets from the top down to its own k-th best are sent on, because no
   lower one can hold the global k-th best;
2. Spark adds up the counts and finds, per query, the bucket with the k-th best score and how many lie above it;
3. that bucket is the range of the next round, with buckets 1/``BUCKETS`` as wide, until it is one score wide or
   all of it is needed.

A last pass keeps the scores from that value upwards, at most k of a query per task, and ties go to the smaller id.
A lost executor costs its tasks of the running round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwise.functions.running import running
from poolwise.llm.scratch import Scratch

#: Buckets of a query's histogram, a power of two.
BUCKETS = 1024
#: Scores that a task holds at a time.
HELD = 1 << 20


def _by_length(ids: np.ndarray, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, matrix) for each length of the vectors; vectors hold no nulls."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, ids[rows], flat[offsets[rows][:, None] + np.arange(size)].reshape(len(rows), size)


class Block:
    """Queries of one pass, grouped by length, and for each the ``count`` buckets, 2 ** ``shift`` wide from ``low`` on, that hold its k-th best score."""

    def __init__(self, ids: np.ndarray, lists: pa.ListArray, k: int, kind: type, longest: float):
        self.ids, self.k, self.kind = ids, k, kind
        self.parts = {m.shape[1]: (rows, own, m.astype(kind)) for rows, own, m in _by_length(ids, lists)}
        self.low, self.shift = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        self.count = np.full(len(ids), BUCKETS, dtype=np.int64)
        self.need, self.open = np.full(len(ids), k, dtype=np.int64), np.ones(len(ids), dtype=bool)
        for rows, _, m in self.parts.values():
            bound = (np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) * longest * (1 + 1e-9)).astype(np.int64) + 1
            self.low[rows] = -bound
            self.shift[rows] = [max(0, int(2 * b + 1).bit_length() - int(math.log2(BUCKETS))) for b in bound]

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, ids, scores, own): a row per query and a column per candidate; ``own`` marks the query's own id."""
        for _, ids, m in _by_length(batch["vec_id"].to_numpy(), batch["vector"]):
            if m.shape[1] not in self.parts:
                continue
            rows, own, queries = self.parts[m.shape[1]]
            step = max(1, HELD // len(rows))
            for start in range(0, len(ids), step):
                some = ids[start:start + step]
                yield rows, some, (queries @ m[start:start + step].astype(self.kind).T).astype(np.int64), own[:, None] == some

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (query, bucket, need, n) of the buckets that can hold the k-th best."""
        counts = np.zeros((len(self.ids), BUCKETS), dtype=np.int64)
        for batch in batches:
            for rows, _, scores, own in self.scores(batch):
                bucket = (scores - self.low[rows, None]) >> self.shift[rows, None]
                hit = (bucket >= 0) & (bucket < self.count[rows, None]) & ~own & self.open[rows, None]
                np.add.at(counts.ravel(), (rows[:, None] * BUCKETS + bucket)[hit], 1)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        query, bucket = np.nonzero((counts > 0) & (above < self.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(self.need[query]), pa.array(counts[query, bucket])],
                                         names=["query", "bucket", "need", "n"])

    def narrow(self, found: list[tuple[int, int, int, int]]) -> None:
        """Go on inside the buckets (query, bucket, scores in it, scores in it and above); a query without one has too few candidates."""
        still = np.zeros(len(self.ids), dtype=bool)
        for query, bucket, n, reached in found:
            self.low[query] += bucket << self.shift[query]
            self.need[query] -= reached - n
            still[query] = self.shift[query] > 0 and n > self.need[query]
            if still[query]:
                finer = max(0, self.shift[query] - int(math.log2(BUCKETS)))
                self.count[query], self.shift[query] = 1 << (self.shift[query] - finer), finer
        self.open = still

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (query, query_id, vec_id, score): the task's k best of those from the located value upwards."""
        held = [np.zeros(0, dtype=np.int64)] * 3

        def cut(columns: list[np.ndarray]) -> list[np.ndarray]:
            order = np.lexsort((columns[1], -columns[2], columns[0]))
            query = columns[0][order]
            first = np.searchsorted(query, query)
            return [c[order][np.arange(len(query)) - first < self.k] for c in columns]

        for batch in batches:
            for rows, ids, scores, own in self.scores(batch):
                query, column = np.nonzero((scores >= self.low[rows, None]) & ~own)
                held = [np.concatenate(pair) for pair in zip(held, (rows[query], ids[column], scores[query, column]), strict=True)]
                if len(held[0]) > HELD // 4:
                    held = cut(held)
        query, ids, scores = cut(held)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(self.ids[query]), pa.array(ids), pa.array(scores)],
                                         names=["query", "query_id", "vec_id", "score"])


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id and floor(scale * x) of every component, as doubles that hold whole numbers; unusable rows are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("scaled")).select(
        "vec_id", F.transform("scaled", lambda x: x - F.pmod(x, F.lit(1.0))).alias("vector"))


def top_scores(vectors: DataFrame, asks: Column, k: int = 5, scale: float = 256, block: int = 4096, block_bytes: int = 8 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best inner products of each row that ``asks`` with all other rows.

    ``vectors``: vec_id, embedding (further columns are ignored); components become floor(scale * x).  Rows with a null
    vec_id, a null vector, or a null or non-finite component neither ask nor answer.  Only vectors of one length are
    compared; empty ones score 0.  Rows with the query's vec_id are never its answers.  Repeated rows are rows of their
    own: each asks and each answers.  Ties go to the smaller vec_id; fewer than ``k`` candidates are all returned; no
    rows give none.  Scores beyond 2 ** 62 end the job by name.

    A block has at most ``block`` queries and ``block_bytes`` of vectors; only blocks, and two numbers a query, reach
    the driver.
    """
    with Scratch(vectors.sparkSession) as scratch:
        rows = scratch.write(quantised(vectors, scale), "vectors")
        norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        size, squares = rows.agg(F.max(F.size("vector")), F.max(norm)).first()
        longest = math.sqrt(squares or 0.0)
        if longest * longest >= 2.0 ** 62:
            raise ValueError("scores do not fit into a long")
        kind = np.float64 if longest * longest < 2.0 ** 51 else np.int64
        asked = scratch.write(running(rows.where(asks), [], ["vec_id", "vector"]), "asked")
        step = max(1, min(block, block_bytes // (8 * max(1, size or 1))))
        parts = []
        for start in range(0, asked.count(), step):
            table = asked.where(F.col("position").between(start + 1, start + step)).orderBy("position").select("vec_id", "vector").toArrow().combine_chunks()
            queries = Block(table["vec_id"].to_numpy(), table["vector"].chunk(0), k, kind, longest)
            while queries.open.any():
                counted = rows.mapInArrow(queries.histogram, "query int, bucket int, need long, n long")
                counted = counted.groupBy("query", "bucket", "need").agg(F.sum("n").alias("n"))
                reached = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bucket"))).alias("reached")
                found = counted.select("query", "bucket", "need", "n", reached).where("reached >= need AND reached - n < need")
                queries.narrow([tuple(r) for r in found.select("query", "bucket", "n", "reached").collect()])
            kept = rows.mapInArrow(queries.best, "query int, query_id long, vec_id long, score long")
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")).alias("rank")
            parts.append(scratch.write(kept.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k), "best"))
        if not parts:
            parts = [vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return scratch.keep(out, "top-scores")
