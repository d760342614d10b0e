"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge
loss fitted by dual coordinate descent.

The grams are runs of one to three word forms.  A form keeps what a word looks like, not what it says: its case, its
outer signs, digits, whether it repeats the word before.  Beside them stand indicators of the whole text: its length,
its share of different words, of signs, of capitals, in steps.  Class counts come from all rows that teach,
by a grouping over hashed grams; the hinge loss is fitted on a bounded sample (``sample`` rows, one fifth of which turns
margins into scores).

labels, lang, source and doc_id are never inputs of a score.  Null and empty texts hold the indicators of an empty
text.  Without teaching rows of both classes every score is 1.  Scoring shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poolwise.llm import words as W
from poolwise.llm.labelled import remainder, sampled, taught
from poolwise.llm.scratch import Scratch

#: Buckets of hashed grams, and rows of the sample.
BUCKETS, SAMPLE = 18, 10_000


def _kinds() -> np.ndarray:
    """Byte kinds: 0 sign, 1 capital, 2 small letter (and all beyond ASCII), 3 digit."""
    kinds = np.zeros(256, dtype=np.int8)
    kinds[0x41:0x5B], kinds[0x61:0x7B], kinds[0x30:0x3A], kinds[0x80:] = 1, 2, 3, 2
    return kinds


KINDS = _kinds()


def forms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram): the distinct hashed grams and indicators of each text."""
    starts, ends, ranges = W.spans(buf, off, W.TEXT)
    kinds = KINDS[buf]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(ranges))
    owner, found = [], []
    shares = np.zeros((len(off) - 1, 4))
    different = np.zeros(len(off) - 1)
    if len(starts):
        inside = [np.concatenate(([0], np.cumsum(kinds == k))) for k in range(4)]
        sign, upper, lower, digit = (c[ends] - c[starts] for c in inside)
        for k, counts in enumerate((sign, upper, lower, digit)):
            shares[:, k] = np.bincount(doc, weights=counts, minlength=len(off) - 1)
        words = W.range_hash(W.prefix_sums(buf), starts, ends)
        again = np.concatenate(([False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])))
        case = np.where(upper + lower == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, np.where(upper > 1, 2, 3), np.where((upper == 1) & (kinds[starts] == 1), 3, 4))))
        head = np.where(kinds[starts] == 0, buf[starts], 0).astype(np.uint64)
        tail = np.where(kinds[ends - 1] == 0, buf[ends - 1], 0).astype(np.uint64)
        signs = np.minimum(sign, 4).astype(np.uint64)
        form = (((head * np.uint64(256) + tail) * np.uint64(8) + signs) * np.uint64(8) + case.astype(np.uint64)) * np.uint64(4) + (digit > 0).astype(np.uint64) * np.uint64(2) + again.astype(np.uint64)
        form = W.mix(form + np.uint64(1))
        for n in (1, 2, 3):
            grams = W.gram_hash(form, n)
            ok = W.inside(ranges, n)[:len(grams)]
            owner.append(doc[:len(grams)][ok])
            found.append(W.mix(grams[ok] + np.uint64(n)))
        order = np.lexsort((words, doc))
        fresh = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
        different = np.bincount(doc[order][fresh], minlength=len(off) - 1) / np.maximum(1, np.diff(ranges))
    count = np.diff(ranges)
    length = np.log2(count + 1).astype(np.uint64)
    total = np.maximum(1, shares.sum(axis=1, keepdims=True))
    steps = np.concatenate((np.minimum(9, (shares / total) ** 0.5 * 10), (different[:, None] * 10)), axis=1).astype(np.uint64)
    whole = [length, *(steps[:, k] for k in range(5)), steps[:, 4] * np.uint64(32) + length]
    for i, value in enumerate(whole):
        owner.append(np.arange(len(off) - 1))
        found.append(W.mix(value + np.uint64((i + 1) << 32)))
    both = (np.concatenate(owner).astype(np.int64) << BUCKETS) | (np.concatenate(found) >> np.uint64(64 - BUCKETS)).astype(np.int64)
    both = np.unique(both)
    return both >> BUCKETS, both & ((1 << BUCKETS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, good, n): texts of the task that hold the gram."""
    n, good = np.zeros(1 << BUCKETS, dtype=np.int64), np.zeros(1 << BUCKETS, dtype=np.int64)
    for batch in batches:
        for rows, buf, off in W.chunks(batch):
            label = rows["label"].to_numpy()
            doc, gram = forms(buf, off)
            np.add.at(n, gram, 1)
            np.add.at(good, gram[label[doc] == 1], 1)
    some = np.flatnonzero(n)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(good[some]), pa.array(n[some])], names=["gram", "good", "n"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in W.chunks(batch):
            doc, gram = forms(buf, off)
            lengths = np.searchsorted(doc, np.arange(len(rows) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows["label"], pa.ListArray.from_arrays(pa.array(lengths), pa.array(gram.astype(np.int32)))], names=["label", "grams"])


def hinge(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights over the unscaled indicators, and the bias last: dual coordinate descent.

    Rows are the ratios of their grams at unit length, and one constant.  Each step solves one row's dual variable
    exactly, within [0, cost]; the costs of the classes are balanced.
    """
    sign = np.where(label == 1, 1.0, -1.0)
    share = np.array([(sign < 0).mean(), (sign > 0).mean()])
    bound = cost * 0.5 / np.where(sign > 0, share[1], share[0])
    values = []
    for grams in rows:
        scaled = ratio[grams]
        values.append(scaled / max(1e-12, np.sqrt((scaled * scaled).sum())))
    weight, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in random.permutation(len(rows)):
            grams, x = rows[i], values[i]
            slope = sign[i] * (weight[grams] @ x + bias) - 1.0
            fresh = min(max(alpha[i] - slope / 2.0, 0.0), bound[i])  # |x|^2 + 1 = 2
            step = (fresh - alpha[i]) * sign[i]
            if step:
                weight[grams] += step * x
                bias += step
                alpha[i] = fresh
    return np.append(weight, bias)


def margins(rows: list[np.ndarray], ratio: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for i, grams in enumerate(rows):
        scaled = ratio[grams]
        out[i] = weight[grams] @ scaled / max(1e-12, np.sqrt((scaled * scaled).sum())) + weight[-1]
    return out


def sigmoid_of(margin: np.ndarray, label: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Slope and shift that turn margins into chances, by gradient steps on smoothed targets."""
    good = label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    slope, shift, squares = 1.0, 0.0, np.full(2, 1e-8)
    for _ in range(rounds):
        slack = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -50, 50))) - target
        gradient = np.array([(slack * margin).mean(), slack.mean()])
        squares += gradient * gradient
        slope, shift = np.array([slope, shift]) - gradient / np.sqrt(squares)
    return max(float(slope), 1e-3), float(shift)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    """Ratios, weights, and the slope and shift of the score; None without both classes."""
    rows = taught(docs, labels, "quality", modulus, held)
    with Scratch(docs.sparkSession) as scratch:
        total, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < good < total:
            return None
        counted = scratch.write(rows.select("text", "label").mapInArrow(_counts, "gram int, good long, n long").groupBy("gram").agg(
            F.sum("good").alias("good"), F.sum("n").alias("n")), "counted").toPandas()  # at most 2**BUCKETS rows
        p, q = np.ones(1 << BUCKETS), np.ones(1 << BUCKETS)
        p[counted["gram"]] += counted["good"]
        q[counted["gram"]] += counted["n"] - counted["good"]
        ratio = np.log((p / (good + 2)) / (q / (total - good + 2)))
        unseen = np.ones(1 << BUCKETS, dtype=bool)
        unseen[counted["gram"]] = False
        ratio[unseen] = 0
        shown = sampled(rows, total, sample, 17).select("text", "label").mapInArrow(_grams, "label int, grams array<int>").toPandas()
    grams, label = [np.asarray(g) for g in shown["grams"]], shown["label"].to_numpy()
    cut = len(grams) - len(grams) // 5
    if len(np.unique(label[:cut])) < 2 or len(np.unique(label[cut:])) < 2:
        cut = 0
    weight = hinge(grams[:cut or None], label[:cut or None], ratio)
    slope, shift = sigmoid_of(margins(grams[cut:], ratio, weight), label[cut:])
    return ratio, weight, slope, shift


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs``, held_out, score and predicted (of a clash, these three win)."""
    model = fit(docs, labels, modulus, held, sample)
    if model:
        ratio, weight, slope, shift = model
        shared = docs.sparkSession.sparkContext.broadcast((ratio.astype(np.float32), (weight[:-1] * ratio).astype(np.float32)))
        bias = weight[-1]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratios, products = shared.value
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
            out = [np.zeros(0)]
            for rows, buf, off in W.chunks(batch):
                doc, gram = forms(buf, off)
                length = np.sqrt(np.bincount(doc, weights=ratios[gram] ** 2, minlength=len(rows)))
                margin = np.bincount(doc, weights=products[gram], minlength=len(rows)) / np.maximum(1e-12, length) + bias
                out.append(1 / (1 + np.exp(-np.clip(slope * margin + shift, -50, 50))))
            yield pd.Series(np.concatenate(out))

    scored = score(F.col("text").cast("string")) if model else F.lit(1.0)
    return (docs.withColumn("score", scored).withColumn("held_out", remainder(F.col("doc_id"), modulus) == held)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
