"""Filter interaction audit by truth-table survival words.

Five filters have 32 subsets and 120 orders.  A document that fails some of them becomes one 32-bit word: bit s is set
when it survives the filters of subset s.  How many documents survive each subset, per part and label, is then a
positional popcount of the words.  Tasks take it with carry-save adders: three words of one weight become one word
of that weight and one of twice the weight, so most words are added 32 counters at a time; a word that stands for n
documents enters at the weights of n's bits.  Every figure of every order is a difference of such counts.

Only a document's id, part, failures and text hash move between tasks, never its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwise.llm.scratch import Scratch

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
#: Labels that survivors are counted for: all documents, those of quality 1, those marked toxic.
LABELS = ("all", "good", "toxic")
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20

_UPPER, _MARKS = bytes(range(0x41, 0x5B)), b"#$%&*|"
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def failures(text: bytes, length: int) -> int:
    """Bits 0 to 3 for the filters A to D; ``length`` in code points.  Long texts go piece by piece, cut at white space."""
    words, upper, marked, start = 0, 0, False, 0
    different: set[bytes] = set()
    while start < len(text):
        end = _WHITE.search(text, start + PIECE) if start + PIECE < len(text) else None
        piece = text[start:end.start() if end else len(text)]
        found = piece.split()
        words += len(found)
        different.update(found)
        upper += len(piece) - len(piece.translate(None, _UPPER))
        marked = marked or any(m in piece for m in _MARKS)
        start += len(piece)
    return (words < 100) | (100 * len(different) < 80 * words) << 1 | (100 * upper > 10 * length) << 2 | marked << 3


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, failed, print)."""
    for batch in batches:
        failed, prints = [], []
        for value in batch["text"]:
            text = value.as_py() or ""
            data = text.encode()
            failed.append(failures(data, len(text)))
            prints.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(failed, pa.int32()), pa.array(prints, pa.binary())],
                                         names=["doc_id", "part", "failed", "print"])


def survival_words() -> np.ndarray:
    """For each set of failed filters the word whose bit s says that subset s lets the document through."""
    return np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32)


def positional_counts(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How many documents set each bit, when word i stands for ``weights[i]`` of them."""
    total = np.zeros(SUBSETS, dtype=np.int64)
    level, carried = 0, np.zeros(0, dtype=np.uint32)
    while len(carried) or (weights >> level).any():
        column, carries = np.concatenate((words[(weights >> level) & 1 == 1], carried)), [carried[:0]]
        while len(column) > 2:
            third = len(column) // 3
            a, b, c, rest = column[:third], column[third:2 * third], column[2 * third:3 * third], column[3 * third:]
            half = a ^ b
            carries.append((a & b) | (half & c))
            column = np.concatenate((half ^ c, rest))
        for word in column:
            total += (int(word) >> np.arange(SUBSETS) & 1) << level
        level, carried = level + 1, np.concatenate(carries)
    return total


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, label, subset, n), zeros included, of the parts that the task met."""
    words = survival_words()
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        names, where = np.unique(np.array(batch["part"].to_pylist(), dtype=object), return_inverse=True)
        failed, n = batch["failed"].to_numpy(), batch["n"].to_numpy()
        for i, name in enumerate(names):
            total = totals.setdefault(name, np.zeros((len(LABELS), SUBSETS), dtype=np.int64))
            for place, label in enumerate(LABELS):
                own = where == i
                if label != "all":
                    own &= batch[label].to_numpy(zero_copy_only=False)
                total[place] += positional_counts(words[failed[own]], n[own])
    for name, total in totals.items():
        place, subset = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([name] * total.size, pa.string()), pa.array(place.ravel().astype(np.int32)), pa.array(subset.ravel().astype(np.int32)),
                                          pa.array(total.ravel())], names=["part", "label", "subset", "n"])


def marked_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, good, toxic, failed, n): how many documents of a part fail which filters, as bits A to E, by label.

    E needs the smallest doc_id of each text.  Rows alike are combined before every shuffle, so a text or a doc_id that
    a third of the rows share is no hot key.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_marks, "doc_id long, part string, failed int, print binary")
    rows = rows.groupBy("doc_id", "print", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(flags.where("good OR toxic"), "doc_id", "left")
    yes = {c: F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")}
    same = rows.select("doc_id", "print", "part", "failed", "n", yes["good"], yes["toxic"]).groupBy("print", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    same = same.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("print")))
    originals = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("failed"), originals.alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - originals).alias("n")))
    out = same.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", F.col("x.failed").alias("failed"), F.col("x.n").alias("n"))
    return scratch.write(out.where("n > 0"), "marked")


def survivors(marked: DataFrame) -> DataFrame:
    """(part, n): survivors of each of the 32 subsets, first of all documents, then of good, then of toxic ones."""
    counted = marked.mapInArrow(_counts, "part string, label int, subset int, n long").groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))
    listed = counted.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("label", "subset", "n"))).alias("all"))
    return listed.select("part", F.transform("all", lambda x: x["n"]).alias("n"))


def _power(letter: Column) -> Column:
    """The filter's bit in a subset."""
    return F.pow(F.lit(2), F.ascii(letter) - F.lit(ord("A"))).cast("int")


def _shapley(letter: int) -> Column:
    """What a filter removes, summed over all orders: the survivors of each subset times the orders that begin with it."""
    times = []
    for s in range(SUBSETS):
        before = (s & ~(1 << letter)).bit_count()
        times.append((-1 if s >> letter & 1 else 1) * factorial(before) * factorial(len(LETTERS) - 1 - before))
    product = F.zip_with(F.slice("n", 1, SUBSETS), F.array(*map(F.lit, times)), lambda a, b: a * b)
    return F.aggregate(product, F.lit(0).cast("long"), lambda a, b: a + b)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row per part (``lang``; null counts as the empty string), order of the filters and step.  ``docs``: doc_id, text,
    lang; ``labels``: doc_id, quality, toxic; further columns are ignored.  A null text is empty; it has no words, no
    code points and equals other empty texts.  Repeated rows are documents of their own; rows that share the smallest
    doc_id of a text are all no copies, and a row without doc_id neither is nor makes a copy.  A document is good or
    toxic if any of its labels says so; null labels say nothing.  No documents give no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        counts = survivors(marked_documents(docs, labels, scratch)).withColumn("shapley", F.array(*map(_shapley, range(len(LETTERS)))))
        orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))).alias("filter_order")
        steps = counts.select("*", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
        bit = F.ascii("letter") - F.lit(ord("A"))
        before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("place")), F.lit(0), lambda a, c: a + _power(c))
        steps = steps.select("*", bit.alias("bit"), _power(F.col("letter")).alias("own"), before.alias("before"))

        def left(subset: Column, label: str = "all") -> Column:
            return F.get("n", subset + F.lit(LABELS.index(label) * SUBSETS))

        def lost(label: str) -> Column:
            return left(F.col("before"), label) - left(F.col("before") + F.col("own"), label)

        failing = left(F.lit(0)) - left(F.col("own"))
        out = steps.select("part", "filter_order", (F.col("place") + 1).cast("int").alias("step"), left(F.col("before") + F.col("own")).alias("kept"), lost("all").alias("removed"),
                           (failing - lost("all")).alias("redundant"), (left(F.lit(SUBSETS - 1) - F.col("own")) - left(F.lit(SUBSETS - 1))).alias("unique_fails"),
                           lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("bit")).alias("shapley"))
        return scratch.keep(out, "filter-audit")
