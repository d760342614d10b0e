"""Benchmark passages in documents by Wu-Manber search over words.

Every window of ``size`` consecutive words of an item is a pattern (an item with fewer words is one pattern).
Patterns of one length share three tables: how far the search may jump when it sees a block of two words that
ends no pattern (shift), the patterns that end with a block (buckets), and the patterns themselves, which are
compared word by word before anything counts.

Words are ASCII-lower-cased runs of digits, letters a-z and characters from U+0080 on.  Null or empty texts have
no words; items without words have no patterns; a null item_id marks words as hit but is not listed; items that
share an id count once; repeated documents are rows of their own.  An empty benchmark leaves all clean.

Nothing of the documents is shuffled while the benchmark fits one block of ``block_bytes`` of text; a larger
benchmark is searched in as many blocks as it takes, each broadcast in turn (so the broadcast is bounded), and
each document's marks are united by one grouping.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from poolwise.llm.scratch import Scratch, keyed

#: Words of a text, after its UTF-8 bytes were lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+").findall
#: Text of the benchmark that one broadcast may hold.
BLOCK_BYTES = 8 << 20

MARKS = "n_words long, starts array<int>, ends array<int>, items array<string>"


class Patterns:
    """The three tables for all patterns of ``m`` words."""

    def __init__(self, m: int, patterns: dict[tuple, set[str]]):
        self.m, self.block = m, min(2, m)
        self.jump = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[str]]] = defaultdict(dict)
        for words, items in patterns.items():
            for end in range(self.block, m + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), m - end)
            self.buckets[words[m - self.block:]][words] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence, from left to right."""
        m, block, jump, shift, n = self.m, self.block, self.jump, self.shift, len(words)
        end = m
        while end <= n:
            key = tuple(words[end - block:end])
            step = shift.get(key, jump)
            if step:
                end += step
                continue
            items = self.buckets[key].get(tuple(words[end - m:end]))
            if items is not None:
                yield end - m, items
            end += 1


def build(rows: list, size: int) -> list[Patterns]:
    """Tables by pattern length for the (item_id, text) rows of one block."""
    by_length: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in rows:
        words = WORD((text or "").encode().lower())
        m = min(size, len(words))
        for start in range(len(words) - m + 1 if words else 0):
            by_length[m][tuple(words[start:start + m])] |= set() if item is None else {str(item)}
    return [Patterns(m, dict(patterns)) for m, patterns in sorted(by_length.items())]


def marks(tables: list[Patterns], text: str | None) -> tuple[int, list[int], list[int], list[str]]:
    """Number of words, disjoint ranges of hit words, and the ids of items found."""
    words = WORD((text or "").encode().lower())
    found: set[str] = set()
    hits = []
    for table in tables:
        for start, items in table.search(words):
            hits.append((start, start + table.m))
            found |= items
    starts, ends = [], []
    for start, end in sorted(hits):
        if ends and start <= ends[-1]:
            ends[-1] = max(end, ends[-1])
        else:
            starts.append(start)
            ends.append(end)
    return len(words), starts, ends, sorted(found)


def _marker(spark, rows: list, size: int):
    shared = spark.sparkContext.broadcast(build(rows, size))

    @F.pandas_udf(MARKS)
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([marks(shared.value, t) for t in texts], columns=["n_words", "starts", "ends", "items"])

    return mark


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES,
                  carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (doc_id and text unless given), n_words, n_hit, starts and ends (ranges of hit words), items (ids, sorted), contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    carry = carry or ["doc_id", "text"]
    packed = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    if blocks == 1:
        out = docs.select(packed, _marker(spark, items.collect(), size)(F.col("text").cast("string")).alias("mark"))
    else:
        with Scratch(spark) as scratch:
            rows = keyed(docs, packed)
            parts = None
            for i in range(blocks):
                mark = _marker(spark, items.where(block == i).collect(), size)
                part = scratch.write(rows.select("key", mark("text").alias("mark")).distinct().select("key", "mark.*"), "marks")
                parts = part if parts is None else parts.union(part)
            ranges = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
            united = parts.groupBy("key").agg(F.first("n_words").alias("n_words"), F.array_sort(ranges).alias("ranges"),
                                              F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            merged = F.aggregate("ranges", F.expr("CAST(array() AS array<struct<starts:int,ends:int>>)"), lambda done, r: F.when(
                (F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= r["starts"]),
                F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["ends"], r["ends"]).alias("ends"))))
            ).otherwise(F.concat(done, F.array(r))))
            united = united.withColumn("ranges", F.when(F.size("ranges") == 0, F.col("ranges")).otherwise(merged))
            mark = F.struct("n_words", F.col("ranges.starts").alias("starts"), F.col("ranges.ends").alias("ends"), "items")
            united = scratch.keep(united.select("key", mark.alias("mark")), "decontaminate")
        out = rows.join(united, "key").select("row", "mark")
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    marked = out.select("row", "mark.*").withColumn("n_hit", hit)
    fresh = ["n_words", "n_hit", "starts", "ends", "items"]
    return marked.select(*(F.col(f"row.`{c}`").alias(c) for c in carry if c not in (*fresh, "contaminated")),
                         *fresh, (F.col("n_hit") > 0).alias("contaminated"))
