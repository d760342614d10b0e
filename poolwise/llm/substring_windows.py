"""Repeated token windows: Rabin-Karp hashes of every fixed-length window, counted in Spark.

A word is removed when it lies in a window of ``size`` words whose word sequence also starts in a document with a
smaller doc_id.  Windows are judged on the input.  Three passes, each a plain Spark shuffle:

1. Every window names its rarest-looking ``gram`` (the sub-window with the smallest rolling hash, which the window's
   words alone decide).  Neighbouring windows share it, so this is one row per five words.  Windows whose gram
   occurs in one document only cannot repeat across documents, and the first document with a gram loses none.
2. All other windows are hashed and the smallest doc_id of each hash is found (64 bits, and 32 of the gram's).
3. Windows with a smaller doc_id elsewhere are gathered by document and merge into maximal removal intervals.

Null or empty texts have no words and keep an empty text; texts shorter than a window lose nothing; rows that
share a doc_id never remove each other's words; a null doc_id is neither smaller nor larger than any other.
Copies and common passages are counted map-side first, so a group of copies with a third of all rows meets no
single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poolwise.llm import words as W
from poolwise.llm.scratch import Scratch, keyed


def _hashed(buf: np.ndarray, off: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, ranges = W.spans(buf, off, W.TEXT)
    words = W.range_hash(W.prefix_sums(buf), starts, ends)
    return words, W.gram_hash(words, gram), ranges


def _grams(size: int, gram: int):
    """Rows (gram, doc_id, key, low, count): ``count`` consecutive windows from word ``low`` that name the gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                _, grams, ranges = _hashed(buf, off, gram)
                at = W.leftmost_minima(grams, size - gram + 1)
                if not len(at):
                    continue
                place = np.flatnonzero(W.inside(ranges, size)[:len(at)])
                doc = np.searchsorted(ranges, place, side="right") - 1
                first, count = W.runs(doc, at[place])
                low, doc = place[first], doc[first]
                taken = rows.select(["doc_id", "key"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [W.signed(grams[at[low]]), taken["doc_id"], taken["key"], pa.array((low - ranges[doc]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["gram", "doc_id", "key", "low", "count"])
    return run


def _windows(size: int, gram: int):
    """Rows (window, gram, doc_id, key, place, late) for the windows that the row's lists name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                words, grams, ranges = _hashed(buf, off, gram)
                whole, at = W.gram_hash(words, size), W.leftmost_minima(grams, size - gram + 1)
                lists = rows["named"]
                lengths = np.diff(lists.offsets.to_numpy())
                named = lists.flatten()
                owner = np.repeat(np.arange(len(lengths)), lengths)
                low = named.field("low").to_numpy().astype(np.int64) + ranges[owner]
                index, place = W.unfold(low, named.field("count").to_numpy().astype(np.int64))
                doc = owner[index]
                taken = rows.select(["doc_id", "key"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [W.signed(whole[place]), pa.array(grams[at[place]].astype(np.uint32).view(np.int32)), taken["doc_id"], taken["key"],
                     pa.array((place - ranges[doc]).astype(np.int32)), named.field("late").take(pa.array(index))],
                    names=["window", "gram", "doc_id", "key", "place", "late"])
    return run


def _cut(size: int):
    """Rows (doc_id, n_words, starts, ends, kept)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                places = rows["places"]
                out = {name: [] for name in ("n_words", "starts", "ends", "kept")}
                for i in range(len(rows)):
                    words = buf[off[i]:off[i + 1]].tobytes().split()  # at ASCII white space
                    starts = ends = np.zeros(0, dtype=np.int64)
                    if places[i].is_valid:
                        at = np.sort(places[i].values.to_numpy().astype(np.int64))
                        hit = W.covered(at, at + size, len(words))
                        edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                        left = b" ".join(compress(words, ~hit))
                    else:
                        left = b" ".join(words)
                    for name, value in zip(out, (len(words), starts, ends, left), strict=True):
                        out[name].append(value)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["starts"], ints), pa.array(out["ends"], ints), pa.array(out["kept"], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "starts", "ends", "kept"])
    return run


def repeated_windows(docs: DataFrame, size: int = 13, gram: int = 5) -> DataFrame:
    """doc_id, n_words, starts, ends (maximal removed ranges of words), kept (the other words, joined by a space)."""
    rows = keyed(docs)
    with Scratch(docs.sparkSession) as scratch:
        grams = rows.mapInArrow(_grams(size, gram), "gram long, doc_id long, key long, low int, count int")
        shared = grams.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram", "a")
        shared = scratch.write(shared, "shared")
        late = F.coalesce(F.col("doc_id") > F.col("a"), F.lit(False)).alias("late")
        named = grams.join(shared, "gram").select("key", F.struct("low", "count", late).alias("one"))
        named = scratch.write(named.groupBy("key").agg(F.collect_set("one").alias("named")), "named")
        windows = rows.join(named, "key").select("doc_id", "key", "text", "named").mapInArrow(
            _windows(size, gram), "window long, gram int, doc_id long, key long, place int, late boolean")
        windows = scratch.write(windows, "windows")
        scratch.drop(shared, named)
        first = windows.groupBy("window", "gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
        first = scratch.write(first.select("window", "gram", "a"), "first")  # so that a hot window's join can be split
        again = windows.where("late").join(first, ["window", "gram"]).where("a < doc_id")
        places = scratch.write(again.groupBy("key").agg(F.collect_set("place").alias("places")), "places")
        scratch.drop(windows, first)
        cut = rows.join(places, "key", "left").select("doc_id", "text", "places").mapInArrow(
            _cut(size), "doc_id long, n_words long, starts array<int>, ends array<int>, kept string")
        return scratch.keep(cut, "repeated-windows")
