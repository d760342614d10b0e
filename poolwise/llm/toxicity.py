"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. *Lexicons.*  Entries are words, and word beginnings (4 to 8 characters) with the number of different words of the
   text that start so: one entry each for 1, 2 and 3 or more.  They are counted by class in Spark over all rows
   that teach; those that speak for toxicity far beyond chance are kept, strongest first.
   Entries that only came along in long or copied toxic texts are set aside: of the others each stands far above
   chance by the toxic texts of the sample that those before it left open.
2. *Voters.*  Each voter is a lexicon of its own share of words or beginnings, or a pattern (that many different
   entries at once).  A voter fires or abstains; the human label is one more voter that may err.
3. *Label model.*  Firing patterns of all rows that teach (at most 2**voters patterns) are counted, and expectation
   maximization finds the class share, every voter's firing rate by class and, from the covariance left inside the
   classes, which voters repeat each other; a voter's weight shrinks by its correlations.
4. *Classifier.*  Logistic regression of the lexicon entries on the posterior labels of a bounded sample
   (``sample`` rows) gives the score of every text.  Its penalty holds weights at what is known without data (zero,
   or a fixed weight for the fixed lexicon) unless the rows say otherwise, so entries that only came along in some
   long or copied toxic texts get no weight.

labels, lang, source and doc_id are never inputs of a score.  A null or empty text scores like one without any
entry.  Without teaching rows of both classes there is no lexicon and every score is 0.  Scoring shuffles nothing.
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

#: Buckets of hashed entries, entries kept, lexicon voters, pattern voters (so many entries at once), rows of the classifier's sample.
BUCKETS, ENTRIES, LEXICONS, AT_ONCE, SAMPLE = 21, 2048, 12, (1, 2, 3, 5), 20_000
#: Characters of a word beginning, most different words that are told apart, and deviations above chance asked of an entry.
BEGINNINGS, DIFFERENT, FAR = (4, 5, 6, 7, 8), 3, 4.0
#: Common English insults, and the weight that each has before any row is seen.
INSULTS = ("idiot moron imbecile stupid dumb fool scum trash garbage filth vermin loser pathetic worthless useless disgusting "
           "repulsive clown jerk bastard degenerate subhuman retard coward liar pig").split()
INSULT_WEIGHT = 2.5


def entries(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, entry): the distinct hashed words of each text, and its word beginnings by number of different words."""
    buf = W.LOWER[buf]
    starts, ends, ranges = W.spans(buf, off, W.ALNUM)
    sums = W.prefix_sums(buf)
    some = np.diff(ranges) > 0
    text = np.flatnonzero(some)
    rank = np.repeat(np.arange(len(text), dtype=np.uint64), np.diff(ranges)[some])  # below 2**20, as a chunk has no more words
    words = W.range_hash(sums, starts, ends)
    _, first = np.unique((rank << np.uint64(44)) | (words >> np.uint64(20)), return_index=True)
    starts, ends, rank, words = starts[first], ends[first], rank[first], words[first]
    heads = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of characters
    place = np.searchsorted(heads, starts)
    heads = np.append(heads, np.full(max(BEGINNINGS) + 1, len(buf) + 1))
    heads[len(heads) - max(BEGINNINGS) - 1] = len(buf)
    owner, found = [rank], [words]
    for n in BEGINNINGS:
        stop = heads[place + n]
        long = stop <= ends
        begins = W.mix(W.range_hash(sums, starts[long], stop[long]) + np.uint64(n))
        both = np.sort((rank[long] << np.uint64(44)) | (begins >> np.uint64(20)))
        at, count = W.runs(both, both)
        for different in range(1, DIFFERENT + 1):
            one = both[at[count >= different]]
            owner.append(one >> np.uint64(44))
            found.append(W.mix((one << np.uint64(20)) + np.uint64(different)))
    both = (np.concatenate(owner) << np.uint64(BUCKETS)) | (np.concatenate(found) >> np.uint64(64 - BUCKETS))
    both = np.unique(both)
    return text[(both >> np.uint64(BUCKETS)).astype(np.int64)], (both & np.uint64((1 << BUCKETS) - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entry, toxic, n): texts of the task that hold the entry."""
    n, toxic = np.zeros(1 << BUCKETS, dtype=np.int32), np.zeros(1 << BUCKETS, dtype=np.int32)
    for batch in batches:
        for rows, buf, off in W.chunks(batch):
            label = rows["label"].to_numpy()
            doc, entry = entries(buf, off)
            np.add.at(n, entry, 1)
            np.add.at(toxic, entry[label[doc] == 1], 1)
    for begin in range(0, len(n), 1 << 16):
        some = np.flatnonzero(n[begin:begin + (1 << 16)]) + begin
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(toxic[some]), pa.array(n[some])], names=["entry", "toxic", "n"])


def _present(kept: np.ndarray):
    """Rows (label, places): which kept entries each text holds."""
    place_of = np.full(1 << BUCKETS, -1, dtype=np.int16)
    place_of[kept] = np.arange(len(kept))
    kept_of = np.flatnonzero(place_of >= 0)
    places = place_of[kept_of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << BUCKETS, -1, dtype=np.int16)
        table[kept_of] = places
        for batch in batches:
            for rows, buf, off in W.chunks(batch):
                doc, entry = entries(buf, off)
                place = table[entry]
                doc, place = doc[place >= 0], place[place >= 0]
                lengths = np.searchsorted(doc, np.arange(len(rows) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["label"], pa.ListArray.from_arrays(pa.array(lengths), pa.array(place.astype(np.int32)))], names=["doc_id", "label", "places"])
    return run


def label_model(votes: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each (firing pattern, label) row, the voters' firing rates by class, and their correlations.

    The last voter is the label.  Inside each class voters may correlate; a voter's evidence counts by one over one
    plus its positive correlations with the others, so that copies of one voter weigh as one.
    """
    fired = np.concatenate((votes, label[:, None]), axis=1).astype(float)
    posterior = np.where(label == 1, 0.9, 0.1)
    weight, correlation = np.ones(fired.shape[1]), np.eye(fired.shape[1])
    for turn in range(rounds):
        by_class = np.stack((count * (1 - posterior), count * posterior))
        mass = by_class.sum(axis=1)
        rate = (by_class @ fired + 0.5) / (mass[:, None] + 1.0)
        prior = np.log((mass[1] + 1) / (mass[0] + 1))
        odds = prior + (fired * np.log(rate[1] / rate[0]) * weight + (1 - fired) * np.log((1 - rate[1]) / (1 - rate[0])) * weight).sum(axis=1)
        fresh = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if turn > 3 and np.abs(fresh - posterior).max() < 1e-6:
            break
        posterior = fresh
        covariance = 0
        for c in (0, 1):
            centred = fired - rate[c]
            covariance = covariance + (centred * by_class[c][:, None]).T @ centred
        deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        correlation = covariance / np.outer(deviation, deviation)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + np.clip(correlation, 0, 1).sum(axis=1))
        weight[-1] = 1  # the label is no copy of a lexicon
    return posterior, rate, correlation


def explaining(places: list[np.ndarray], label: np.ndarray, width: int, least: float) -> np.ndarray:
    """Entries, best first, each with ``least`` more to explain: a toxic text counts fully until an entry of it is
    chosen and a quarter until the next.  The best is the one whose count stands most deviations above chance; what
    an entry that clean texts hold too is worth is left to the label model and the classifier."""
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    column = np.concatenate(places) if len(places) else np.zeros(0, dtype=int)
    n, base = np.bincount(column, minlength=width), label.mean() if len(label) else 0.0
    chance, spread = base * n, np.sqrt(np.maximum(1, n) * max(1e-12, base * (1 - base)))
    keep = label[row] == 1
    row, column = row[keep], column[keep]
    value, out = np.ones(len(places)), []
    while True:
        gain = np.bincount(column, weights=value[row], minlength=width)
        far = np.where(gain >= least, (gain - chance) / spread, 0.0)
        far[out] = 0
        best = int(far.argmax())
        if far[best] < FAR:
            return np.array(out, dtype=int)
        out.append(best)
        hit = np.unique(row[column == best])
        value[hit] = np.where(value[hit] == 1.0, 0.25, 0.0)


def _patterns(lookup: np.ndarray):
    """Rows (doc_id, label, pattern, places): which voters fire, and the chosen entries of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, kept = [], []
            for places in batch["places"].to_pylist():
                chosen = lookup[np.asarray(places, dtype=int)]
                chosen = chosen[chosen >= 0]
                kept.append(chosen)
                patterns.append(int(np.bitwise_or.reduce(1 << (chosen % LEXICONS))) if len(chosen) else 0)
                patterns[-1] |= sum(1 << (LEXICONS + i) for i, n in enumerate(AT_ONCE) if len(chosen) >= n)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(patterns, pa.int32()), pa.array(kept, pa.list_(pa.int32()))],
                                             names=["doc_id", "label", "pattern", "places"])
    return run


def insults() -> np.ndarray:
    """The fixed lexicon as entries."""
    out = []
    for word in INSULTS:
        buf = np.frombuffer(word.encode(), dtype=np.uint8)
        out.append(int(W.range_hash(W.prefix_sums(buf), np.array([0]), np.array([len(buf)]))[0] >> np.uint64(64 - BUCKETS)))
    return np.array(sorted(set(out)))


def logistic(places: list[np.ndarray], target: np.ndarray, known: np.ndarray, penalty: float = 0.5, rounds: int = 600) -> np.ndarray:
    """Weights of the entries and, last, the intercept: gradient steps, one step size per weight, each followed by a
    pull of ``penalty`` towards the ``known`` weights, where small differences end."""
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    column = np.concatenate(places) if len(places) else np.zeros(0, dtype=int)
    weight, squares = np.append(known, np.log((target.sum() + 1) / ((1 - target).sum() + 1))), np.full(len(known) + 1, 1.0)
    for _ in range(rounds):
        margin = weight[-1] + np.bincount(row, weights=weight[column], minlength=len(places))
        slack = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target
        gradient = np.append(np.bincount(column, weights=slack[row], minlength=len(known)), slack.sum())
        squares += gradient * gradient
        step = 1 / np.sqrt(squares)
        weight -= gradient * step
        apart = weight[:-1] - known
        weight[:-1] = known + np.sign(apart) * np.maximum(np.abs(apart) - penalty * step[:-1], 0)
    return weight


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Entries, their weights, and the intercept."""
    nothing = np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = taught(docs, labels, "toxic", modulus, held)
        counted = scratch.write(rows.select("text", "label").mapInArrow(_counts, "entry int, toxic int, n int").groupBy("entry").agg(
            F.sum("toxic").alias("toxic"), F.sum("n").alias("n")), "counted")
        total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < toxic < total:
            return nothing
        base = toxic / total
        # how many deviations the toxic count stands above chance, of entries most of whose texts are toxic
        far = (F.col("toxic") - F.lit(base) * F.col("n")) / F.sqrt(F.col("n") * F.lit(base * (1 - base)))
        strong = counted.withColumn("far", far).where((F.col("toxic") >= 2) & (F.col("toxic") > 0.5 * F.col("n")) & (F.col("far") > FAR))
        strong = strong.orderBy(F.desc("far"), "entry").limit(ENTRIES).toPandas()
        fixed = insults()
        kept = np.concatenate((fixed, np.setdiff1d(strong["entry"].to_numpy(), fixed)))
        known = np.where(np.arange(len(kept)) < len(fixed), INSULT_WEIGHT, 0.0)
        shown = rows.mapInArrow(_present(kept), "doc_id long, label int, places array<int>")
        shown = scratch.write(shown, "shown")
        some = sampled(shown, total, sample, 11).select("label", "places").toPandas()
        chosen = explaining([np.asarray(p, dtype=int) for p in some["places"]], some["label"].to_numpy(), len(kept), max(2.0, 0.003 * some["label"].sum()))
        chosen = np.concatenate((np.arange(len(fixed)), chosen[chosen >= len(fixed)]))
        lookup = np.full(len(kept), -1)
        lookup[chosen] = np.arange(len(chosen))
        kept, known = kept[chosen], known[chosen]
        shown = scratch.write(shown.mapInArrow(_patterns(lookup), "doc_id long, label int, pattern int, places array<int>"), "patterns")
        table = shown.groupBy("pattern", "label").count().toPandas()
        votes = (table["pattern"].to_numpy()[:, None] >> np.arange(LEXICONS + len(AT_ONCE))) & 1
        posterior, _, _ = label_model(votes, table["label"].to_numpy(), table["count"].to_numpy().astype(float))
        belief = dict(zip(zip(table["pattern"], table["label"], strict=True), posterior, strict=True))
        rows_of = sampled(shown, total, sample, 13).select("pattern", "label", "places").toPandas()
        target = np.array([belief[p, y] for p, y in zip(rows_of["pattern"], rows_of["label"], strict=True)])
        weight = logistic([np.asarray(p, dtype=int) for p in rows_of["places"]], target, known)
    return kept, weight[:-1], float(weight[-1])


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs``, held_out, score and predicted (of a clash, these three win)."""
    kept, weight, intercept = fit(docs, labels, modulus, held, sample)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << BUCKETS, dtype=np.float32)
        table[kept] = weight
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
            out = [np.zeros(0)]
            for rows, buf, off in W.chunks(batch):
                doc, entry = entries(buf, off)
                out.append(1 / (1 + np.exp(-np.clip(intercept + np.bincount(doc, weights=table[entry], minlength=len(rows)), -50, 50))))
            yield pd.Series(np.concatenate(out))

    scored = score(F.col("text").cast("string")) if len(kept) else F.lit(0.0)
    return (docs.withColumn("score", scored).withColumn("held_out", remainder(F.col("doc_id"), modulus) == held)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
