"""Connected components by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwise.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of every end of the edges (a, b): root is the smallest id that can be reached.

    Each round every vertex tells its larger neighbours, then its smaller ones, of the smallest it knows, so depths
    shrink geometrically while the number of edges never grows.  Minima combine map-side and are written before
    they are joined, so a vertex with very many edges is split like any skewed join.  All rounds are written.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = scratch.write(edges, "edges")
    print_of = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))))
    before = edges.agg(*print_of).first()
    while before[0]:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.write(large, "large")
        least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least).distinct()
        small = scratch.write(small, "small")
        scratch.drop(edges, low, large, least)
        edges, after = small, small.agg(*print_of).first()
        if after == before:
            break
        before = after
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return scratch.write(roots.union(edges.select(F.col("b"), F.col("b")).distinct()).groupBy("id").agg(F.min("root").alias("root")), "roots")
