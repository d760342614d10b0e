"""Repeated substrings by content fingerprints: q-gram buckets, then hashes of byte ranges, counted in Spark.

A byte is removed when a string of ``size`` bytes that also starts anywhere else covers it.  That needs the suffix
order only to depth ``size``, and only inside buckets that hold more than one suffix, so buckets are refined to
that depth and no further, and a bucket of one is dropped at once:

1. *q-gram buckets.*  Each window of ``size`` bytes points to one q-gram in it, the one with the smallest rolling
   hash (the window's bytes alone decide which).  Neighbouring windows share the pointer, so there is one row per
   100 bytes.  Windows whose q-gram stands once in all texts cannot repeat.
2. *Cells.*  The other windows go, 16 offsets from their q-gram together, into the bucket named by the bytes from
   the first window's start to the last one's end.  A cell met twice repeats in all its windows; that settles
   copies and the inside of common passages, counted map-side.
3. *Windows.*  Where several cells share q-gram and offset, one of each kind is split into single windows, named by
   the hashes of the bytes of their first half and of the later half.

Texts are UTF-8 bytes; null and empty ones have none; matches never cross texts; repeated rows are places of their
own.  Names are hashes of 64 bits under a q-gram of 64 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poolwise.llm import words as W
from poolwise.llm.scratch import Scratch, keyed


def _pointers(size: int, q: int):
    """Rows (gram, key, at, least, most): windows that start ``least`` to ``most`` bytes before ``at`` point there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                sums = W.prefix_sums(buf)
                start = np.arange(max(0, len(buf) - q + 1))
                grams = W.range_hash(sums, start, start + q)
                at = W.leftmost_minima(grams, size - q + 1)
                if not len(at):
                    continue
                place = np.flatnonzero(W.inside(off, size)[:len(at)])
                doc = np.searchsorted(off, place, side="right") - 1
                first, count = W.runs(doc, at[place])
                low, doc = place[first], doc[first]
                point = at[low]
                yield pa.RecordBatch.from_arrays(
                    [W.signed(grams[point]), rows["key"].take(pa.array(doc)), pa.array((point - off[doc]).astype(np.int32)), pa.array((point - low - count + 1).astype(np.int32)), pa.array((point - low).astype(np.int32))],
                    names=["gram", "key", "at", "least", "most"])
    return run


def _lists(rows: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """The flattened structs of a list column, and the row of each."""
    lists = rows[name]
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _cell_windows(at: np.ndarray, cell: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of cells, inside the text [begin, end)."""
    return np.maximum(at - cell * width - width + 1, begin), np.minimum(at - cell * width, end - size)


def _cells(size: int, width: int):
    """Rows (gram, cell, name, key, at, low, high): a cell's windows start at ``low`` to ``high`` of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                sums = W.prefix_sums(buf)
                doc, pointers = _lists(rows, "pointers")
                least, most = (pointers.field(n).to_numpy().astype(np.int64) // width for n in ("least", "most"))
                index, cell = W.unfold(least, most - least + 1)
                doc = doc[index]
                at = pointers.field("at").to_numpy().astype(np.int64)[index]
                low, high = _cell_windows(at + off[doc], cell, width, off[doc], off[doc + 1], size)
                name = W.mix(W.range_hash(sums, low, high + size) + (at + off[doc] - high).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pointers.field("gram").take(pa.array(index)), pa.array(cell.astype(np.int32)), W.signed(name), rows["key"].take(pa.array(doc)),
                     pa.array(at.astype(np.int32)), pa.array((low - off[doc]).astype(np.int32)), pa.array((high - off[doc]).astype(np.int32))],
                    names=["gram", "cell", "name", "key", "at", "low", "high"])
    return run


def _windows(size: int, width: int):
    """Rows (gram, name, key, place, settled) for every window of the listed cells."""
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                sums = W.prefix_sums(buf)
                doc, cells = _lists(rows, "cells")
                at = cells.field("at").to_numpy().astype(np.int64) + off[doc]
                low, high = _cell_windows(at, cells.field("cell").to_numpy().astype(np.int64), width, off[doc], off[doc + 1], size)
                index, place = W.unfold(low, high - low + 1)
                name = W.range_hash(sums, place, place + half) * np.uint64(3) + W.range_hash(sums, place + half, place + size)
                name = W.mix(name + (at[index] - place).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [cells.field("gram").take(pa.array(index)), W.signed(name), rows["key"].take(pa.array(doc[index])),
                     pa.array((place - off[doc[index]]).astype(np.int32)), cells.field("settled").take(pa.array(index))],
                    names=["gram", "name", "key", "place", "settled"])
    return run


def _cut(size: int):
    """Rows (doc_id, n_bytes, starts, ends, kept)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                ranges = rows["ranges"]
                starts, ends, kept = [], [], []
                for i in range(len(rows)):
                    text = buf[off[i]:off[i + 1]]
                    begin = end = np.zeros(0, dtype=np.int64)
                    if ranges[i].is_valid:
                        pairs = ranges[i].values
                        hit = W.covered(pairs.field("low").to_numpy().astype(np.int64), pairs.field("high").to_numpy().astype(np.int64) + size, len(text))
                        edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                        text = text[~hit]
                    starts.append(begin)
                    ends.append(end)
                    kept.append(text.tobytes())
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array(np.diff(off)), pa.array(starts, ints), pa.array(ends, ints), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "starts", "ends", "kept"])
    return run


def suffix_dedup(docs: DataFrame, size: int = 400, q: int = 200, width: int = 16) -> DataFrame:
    """doc_id, n_bytes, starts, ends (maximal removed runs of bytes), kept (the other bytes)."""
    rows = keyed(docs)
    long_enough = rows.where(F.octet_length("text") >= size)
    with Scratch(docs.sparkSession) as scratch:
        pointers = long_enough.select("key", "text").mapInArrow(_pointers(size, q), "gram long, key long, at int, least int, most int")
        # right sides are written, so that adaptive execution can split the join on a hot bucket
        buckets = scratch.write(pointers.groupBy("gram").count().where("count > 1").select("gram"), "buckets")
        held = pointers.join(buckets, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "at", "least", "most")).alias("pointers"))
        texts = scratch.write(long_enough.join(held, "key").select("key", "text", "pointers"), "texts")

        cells = texts.mapInArrow(_cells(size, width), "gram long, cell int, name long, key long, at int, low int, high int")
        kinds = cells.groupBy("gram", "cell", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("one"))
        kinds = scratch.write(kinds, "kinds")
        met_twice = kinds.where("n > 1").select("gram", "cell", "name")
        settled = scratch.write(cells.join(met_twice, ["gram", "cell", "name"]).select("key", "low", "high"), "settled")

        several = scratch.write(kinds.groupBy("gram", "cell").count().where("count > 1").select("gram", "cell"), "several")
        split = kinds.join(several, ["gram", "cell"]).groupBy(F.col("one.key").alias("key")).agg(
            F.collect_list(F.struct("gram", "cell", F.col("one.at").alias("at"), (F.col("n") > 1).alias("settled"))).alias("cells"))
        windows = texts.select("key", "text").join(split, "key").mapInArrow(
            _windows(size, width), "gram long, name long, key long, place int, settled boolean")
        windows = scratch.write(windows, "windows")
        scratch.drop(buckets, texts, kinds, several)
        names = scratch.write(windows.groupBy("gram", "name").count().where("count > 1").select("gram", "name"), "names")
        single = windows.where("NOT settled").join(names, ["gram", "name"]).select("key", F.col("place").alias("low"), F.col("place").alias("high"))
        ranges = settled.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
        ranges = scratch.write(ranges, "ranges")
        scratch.drop(settled, windows, names)
        cut = rows.join(ranges, "key", "left").select("doc_id", "text", "ranges").mapInArrow(
            _cut(size), "doc_id long, n_bytes long, starts array<int>, ends array<int>, kept binary")
        return scratch.keep(cut, "suffix-dedup")
