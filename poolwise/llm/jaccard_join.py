"""Exact Jaccard join of word shingles by set relations, with the connected components of its links.

A document's set holds the distinct shingles of ``words`` consecutive words (a shorter text is one shingle).  Equal
sets are one set from the start.  Sets are ordered by shingle frequency, rare ones first, and only the part of a
set that two similar sets must share is indexed.  Then relations between sets save work twice:

* *Skipping in the index.*  Entries stand in their list by position.  An entry meets another only where their
  sizes and positions still allow the overlap that the threshold asks for, tested entry by entry.
* *Skipping by answers.*  The entry that stands first in a list has the fewest rarer shingles, so in a group of
  near copies it is the one closest to all others.  Others are compared to it first.  Sets that are linked with it
  already reach each other: their answer follows from its answer and their pairs are never formed.  Only entries
  of lists in which several components remain meet in pairs, and these are all compared.

Every pair that could link different components is compared, so the components are those of all links.  First by the
parities of the sets: of names counted by their low bits, each place odd in one set and even in the other is a name
that only one of them has, so too many such places rule the pair out for certain.  What remains is compared exactly,
by the whole sets.  The order needs no exact counts: any fixed order gives the same links, so frequencies come from a
summary of all texts (shingles met twice in one task), and its ``frequent`` most common classes are broadcast.

Words are ASCII-lower-cased runs of anything but ASCII white space.  Texts without words, and null texts, have an
empty set and link with nothing.  Rows that share a doc_id are rows of their own.  Of a component without any
doc_id, component_id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poolwise.llm import words as W
from poolwise.llm.graph import components
from poolwise.llm.scratch import Scratch, keyed

#: Shingles that a task counts at a time, and those whose frequency class is broadcast (16 bytes each).
COUNTED, FREQUENT = 2_000_000, 500_000
#: Keys of documents to fetch that may be broadcast (8 bytes each); more meet their texts by a merge join.
FETCHED = 1_000_000
#: Bits of a shingle's name; the class of its frequency stands above them.
NAME = 58


def _shingles(buf: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text."""
    buf = W.LOWER[buf]
    starts, ends, ranges = W.spans(buf, off, W.TEXT)
    words = W.range_hash(W.prefix_sums(buf), starts, ends)
    grams = W.gram_hash(words, n)
    for begin, end in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        if end - begin >= n:
            yield np.unique(grams[begin:end - n + 1])
        else:
            yield W.gram_hash(words[begin:end], end - begin) if end > begin else grams[:0]


def _counts(n: int):
    """Rows (shingle, count) of shingles that the task met in more than one text."""
    def summed(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        name, back = np.unique(np.concatenate(names), return_inverse=True)
        return name, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_names, kept_counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        fresh: list[np.ndarray] = []
        held = 0

        def fold() -> None:
            nonlocal kept_names, kept_counts, held
            if fresh:
                name, count = np.unique(np.concatenate(fresh), return_counts=True)
                name, count = summed([kept_names, name], [kept_counts, count])
                kept_names, kept_counts = name[count > 1], count[count > 1]
                if len(kept_names) > COUNTED:
                    most = np.argpartition(-kept_counts, COUNTED)[:COUNTED]
                    kept_names, kept_counts = kept_names[most], kept_counts[most]
                fresh.clear()
                held = 0

        for batch in batches:
            for _, buf, off in W.chunks(batch):
                for names in _shingles(buf, off, n):
                    fresh.append(names)
                    held += len(names)
                if held >= COUNTED:
                    fold()
        fold()
        for start in range(0, len(kept_names), 1 << 16):
            yield pa.RecordBatch.from_arrays([W.signed(kept_names[start:start + (1 << 16)]), pa.array(kept_counts[start:start + (1 << 16)])], names=["shingle", "count"])
    return run


class Order:
    """The global order of shingles: frequency class first, then hash."""

    def __init__(self, names: np.ndarray, classes: np.ndarray):
        order = np.argsort(names)
        self.names, self.classes = names[order], classes[order].astype(np.uint64)

    def sort(self, shingles: np.ndarray) -> np.ndarray:
        out = shingles >> np.uint64(64 - NAME)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, shingles), len(self.names) - 1)
            out |= np.where(self.names[at] == shingles, self.classes[at], np.uint64(0)) << np.uint64(NAME)
        return np.unique(out)


def parities(names: np.ndarray) -> bytes:
    """One bit per place, a power of two of places, no fewer than names: is the count of names that end there odd?"""
    places = 1 << max(6, (len(names) - 1).bit_length())
    odd = np.bincount((names & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(parity: bytes, size: int) -> int:
    """The parities as a number, on ``size`` bytes: the upper half of the places joins the lower until they fit."""
    number, bits = int.from_bytes(parity, "little"), 8 * len(parity)
    while bits > 8 * size:
        bits //= 2
        number = (number >> bits) ^ (number & ((1 << bits) - 1))
    return number


def apart(a: bytes, b: bytes) -> int:
    """At least so many names are in one set only."""
    size = min(len(a), len(b))
    return (_folded(a, size) ^ _folded(b, size)).bit_count()


def _possible(percent: int):
    """Of rows (a, b, m, n, left, right), the pairs that their parities do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch["m"].to_numpy().astype(np.int64) + batch["n"].to_numpy()
            least = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(batch["left"], batch["right"], strict=True)], dtype=np.int64)
            keep = pa.array((100 + percent) * least <= (100 - percent) * both)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])
    return run


def _sets(shared, n: int, percent: int, whole: bool):
    """Rows (key, doc_id, n, one, two, parity, part): a set's size, its 128-bit name, its parities, and its first or all shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = shared.value
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                sizes, ones, twos, odd, parts = [], [], [], [], []
                for shingles in _shingles(buf, off, n):
                    names = order.sort(shingles)
                    size = len(names)
                    sizes.append(size)
                    mixed = W.mix(names)
                    ones.append(mixed.sum(dtype=np.uint64))
                    odd.append(parities(mixed))
                    twos.append(W.mix(names ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    parts.append(names if whole else names[:size - -(-percent * size // 100) + 1])
                lengths = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
                flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [rows["key"], rows["doc_id"], pa.array(sizes, pa.int32()), W.signed(np.array(ones, dtype=np.uint64)), W.signed(np.array(twos, dtype=np.uint64)),
                     pa.array(odd, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), W.signed(flat))],
                    names=["key", "doc_id", "n", "one", "two", "parity", "part"])
    return run


_SET = "key long, doc_id long, n int, one long, two long, parity binary, part array<long>"


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows, and for each row whether it equals the row before it, also across batches."""
    last = None
    for batch in batches:
        if batch.num_rows:
            values = batch[name].to_numpy()
            same = np.concatenate(([last is not None and values[0] == last], values[1:] == values[:-1]))
            last = values[-1]
            yield batch, same


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, those whose shingle occurs more than once."""
    held = None
    for batch, same in _runs(batches, "shingle"):
        if held is not None and same[0]:
            yield held
        keep = same.copy()
        keep[:-1] |= same[1:]
        keep[-1] = same[-1]
        held = None if same[-1] else batch.slice(batch.num_rows - 1)
        if keep.any():
            yield batch.filter(pa.array(keep))


def may_link(a: str, b: str, percent: int) -> str:
    """Can two entries be the first that their sets share?  Their sizes and what follows them decide."""
    need = f"{percent} * ({a}.n + {b}.n) <= {100 + percent} * least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {need}"


def _pivots(percent: int):
    """Pairs (a, b) of each entry and the first entry of its list, where they may link and differ in component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch, same in _runs(batches, "shingle"):
            column = {name: batch[name].to_numpy().astype(np.int64) for name in ("id", "n", "pos", "root")}
            at = np.maximum.accumulate(np.where(same, -1, np.arange(batch.num_rows)))
            pivot = {name: np.where(at >= 0, values[at], 0 if first is None else first[name]) for name, values in column.items()}
            first = {name: values[-1] for name, values in pivot.items()}
            n, m = column["n"], pivot["n"]
            rest = np.minimum(n - column["pos"], m - pivot["pos"])
            keep = (column["root"] != pivot["root"]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (percent * (n + m) <= (100 + percent) * rest)
            a, b = column["id"][keep], pivot["id"][keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return run


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, pivot_rounds: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, set_id (smallest key of the documents with this very set), component_id, key and keeper
    (true for one key of each component, and for every empty set); one row per row."""
    spark = docs.sparkSession
    rows = keyed(docs)
    texts = rows.select("key", "doc_id", "text")
    with Scratch(spark) as scratch:
        counts = texts.select("text").mapInArrow(_counts(words), "shingle long, count long").groupBy("shingle").agg(F.sum("count").alias("count"))
        counts = scratch.write(counts.select("shingle", F.floor(F.log2(F.col("count"))).cast("int").alias("class")), "counts")
        classes = sorted(((r["class"], r["count"]) for r in counts.groupBy("class").count().collect()), reverse=True)
        floor, total = 64, 0
        for each, n in classes:  # as many of the highest classes as fit
            if (total := total + n) > frequent:
                break
            floor = each
        common = counts.where(F.col("class") >= floor).toPandas()
        shared = spark.sparkContext.broadcast(Order(common["shingle"].to_numpy().view(np.uint64), common["class"].to_numpy()))
        scratch.drop(counts)

        sets = scratch.write(texts.mapInArrow(_sets(shared, words, percent, False), _SET), "sets")
        ids = scratch.write(sets.select("doc_id", "key", "n", "one", "two"), "ids")
        alike = scratch.write(ids.groupBy("n", "one", "two").agg(F.min("key").alias("set_id")), "alike")
        # big tables meet smaller ones by merging at every size, so the plan that was measured is the plan that runs
        chosen = alike.where("n > 0").select(F.col("set_id").alias("key")).distinct().hint("merge")
        entries = sets.join(chosen, "key").select(F.col("key").alias("id"), "n", F.posexplode("part").alias("pos", "shingle"))
        lists = entries.repartition("shingle").sortWithinPartitions("shingle")
        lists = scratch.write(lists.select("shingle", "id", "n", "pos").mapInArrow(_lists, "shingle long, id long, n int, pos int"), "lists")
        odd = scratch.write(sets.where("n > 0").select("key", "n", "parity"), "parities")
        scratch.drop(sets)

        def fetched(table: DataFrame, pairs: DataFrame) -> DataFrame:
            """The rows of both ends of the pairs."""
            ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b"))).distinct()
            ends = scratch.write(ends, "ends")
            used.append(ends)
            return table.join(F.broadcast(ends) if ends.count() <= FETCHED else ends.hint("merge"), "key")

        def side_by_side(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
            """a, b, the sizes m and n, and column ``what`` of both as left and right."""
            left = table.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col(what).alias("left"))
            right = table.select(F.col("key").alias("b"), "n", F.col(what).alias("right"))
            return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "m", "n", "left", "right")

        roots = None  # (id, root) of sets with links so far
        tried = None
        for turn in range(pivot_rounds + 1):
            used = []
            here = lists if roots is None else lists.join(roots.hint("merge"), "id", "left")
            here = here.withColumn("root", F.coalesce("root", "id") if roots is not None else F.col("id"))
            if turn:
                here = scratch.write(here, "here")
                live = here.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("shingle")
                live = scratch.write(live, "live")
                used += [here, live]
                here = here.join(live.hint("merge"), "shingle")
            if turn < pivot_rounds:
                # in turn 0 the entry with the fewest rarer shingles, later another of its kind at random
                order = ["pos", "n", "id"] if not turn else [F.xxhash64("root", F.lit(turn)), F.col("pos"), F.col("id")]
                dealt = here.select("shingle", "id", "n", "pos", "root").repartition("shingle").sortWithinPartitions("shingle", *order)
                pairs = dealt.mapInArrow(_pivots(percent), "a long, b long").distinct()
            else:
                x, y = here.alias("x"), here.alias("y")
                meet = F.expr(f"x.shingle = y.shingle AND x.id < y.id AND x.root <> y.root AND {may_link('x', 'y', percent)}")
                pairs = x.join(y, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = scratch.write(pairs, "pairs")
            near = scratch.write(fetched(odd, pairs), "near")
            open_pairs = scratch.write(side_by_side(pairs, near, "parity").mapInArrow(_possible(percent), "a long, b long"), "open")
            full = fetched(texts, open_pairs).mapInArrow(_sets(shared, words, percent, True), _SET).select("key", "n", "part")
            full = scratch.write(full, "full")
            used += [near, open_pairs, full]
            both = side_by_side(open_pairs, full, "part")
            overlap = F.size(F.array_intersect("left", "right"))
            links = both.select("a", "b", "m", "n", overlap.alias("i")).where((100 + percent) * F.col("i") >= percent * (F.col("m") + F.col("n")))
            links = scratch.write(links.select("a", "b"), "links")
            scratch.drop(*used)
            tried = pairs if tried is None else scratch.write(tried.union(pairs), "tried")
            if roots is None:
                roots = components(links, scratch)
            else:  # only the components so far need to meet
                ends = (links.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left")
                        .join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left"))
                ends = scratch.write(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), "ends")
                step = components(ends, scratch)
                moved = roots.join(step.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
                roots = scratch.write(moved.union(step).groupBy("id").agg(F.min("root").alias("root")), "roots")

        named = ids.join(alike.hint("merge"), ["n", "one", "two"])
        named = named.withColumn("set_id", F.when(F.col("n") > 0, F.col("set_id")).otherwise(F.col("key")))
        named = named.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        named = scratch.write(named.select("doc_id", "key", "n", "set_id", "root", (F.col("key") == F.col("root")).alias("keeper")), "named")
        least = scratch.write(named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
        columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "set_id", "component_id", "key", "keeper"]
        filled = named.where("n > 0").join(least, "root").select(*columns)
        alone = named.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*columns)
        out = filled.union(alone)
        return scratch.keep(out, "jaccard-join")
