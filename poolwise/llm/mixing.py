"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over its source's size.  Within a source, ordered by size and
doc_id, the prefix sums of expected copies start at one random offset, and a document is emitted once for each
integer boundary its step crosses.  Order by size spreads the copies evenly over short and long documents, so the
words taken stay within about one document of the target; a step of at most 3 crosses at most 3 boundaries.

Sources by code point, null last, weigh 1, 2, 3, repeating.  Targets share all words by weight; one that would
pass ``most`` times its source's words stops there and the excess is shared anew until none is above.  Null texts
have size 0; a source without words has target 0 and takes nothing; repeated rows are rows of their own.

Positions within a source come from a range partitioning by (source, size, doc_id) and one count per range and
source, so a source with a third of all rows is spread over all tasks.  The only table that meets in one task has
one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from poolwise.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target, from (source, source_size).  A source stops at ``most`` times its size exactly
    if that is below its share of what the sources stopping before it (smaller size per weight) leave."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = sizes.withColumn("weight", weight.cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    ranked = (weighted.withColumn("left_size", F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), zero))
              .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
              .withColumn("stops", F.lit(most) * F.col("source_size") * F.col("left_weight") <= F.col("left_size") * F.col("weight")))
    # the first source that does not stop fixes what one weight is worth to it and to all after it
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "left_size", "left_weight"))).over(everything)
    leveled = ranked.withColumn("level", level)
    share = (F.col("level.left_size") * F.col("weight")).cast("double") / F.col("level.left_weight").cast("double")
    return leveled.select("source", "source_size", F.when(F.col("stops") | F.col("level").isNull(), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def offset(source, seed: int):
    """A number in [0, 1) from the seed and the source's name."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000"))), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        words = F.when(text == "", F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")
        sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"))
        sized = scratch.write(sized, "sizes")
        source = scratch.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = sized.repartitionByRange(parts, F.col("source"), F.col("size"), F.col("doc_id"))
        ranged = scratch.write(ranged.withColumn("range", F.spark_partition_id()), "ranges")
        counts = ranged.groupBy("source", "range").agg(F.count(F.lit(1)).alias("rows"))
        earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("earlier", F.coalesce(F.sum("rows").over(earlier), F.lit(0).cast("long"))).drop("rows")
        here = Window.partitionBy("source", "range").orderBy("size", "doc_id")
        placed = ranged.withColumn("place", F.row_number().over(here).cast("long"))
        small = counts.join(source, counts["source"].eqNullSafe(source["source"])).select(
            counts["source"].alias("of"), F.col("range").alias("in"), "earlier", "source_size", "target")
        joined = placed.join(small, placed["source"].eqNullSafe(small["of"]) & (F.col("range") == F.col("in")))
        step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
        place = (F.col("earlier") + F.col("place")).cast("double")
        start = offset(F.col("source"), seed)
        copies = F.floor(start + step * place) - F.floor(start + step * (place - F.lit(1.0)))
        out = joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))
        return scratch.keep(out.withColumn("taken", F.col("copies") * F.col("size")), "mix")
