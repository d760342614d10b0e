"""The parts of the two classifiers that are no matter of training, against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from poolwise.llm import quality as Q, toxicity as T, words as W
from poolwise.llm.labelled import remainder, taught

TEXTS = ["", " ", "One two two, THREE! 4four", "é é éa éab Éabc réeuxa réeuxb réeuxc réeuxdé", "you idiot, idiots and idiocy...", "$$$ 12 12 12 ABC abc\nAbC", "x" * 300 + " y"]


def corpus(n=400):
    draw = random.Random(8)
    words = [w for t in TEXTS for w in t.split()] + ["und", "der", "scum", "nice", "Ok.", "réeuxzz", "réeuxqq"]
    return [" ".join(draw.choice(words) for _ in range(draw.randint(0, 25))) for _ in range(n)] + TEXTS


def batch_of(texts):
    (_, buf, off), = W.chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]))
    return buf, off


def hashed(data):
    return int(W.range_hash(W.prefix_sums(np.frombuffer(data, dtype=np.uint8)), np.array([0]), np.array([len(data)]))[0])


def mixed(value):
    return int(W.mix(np.array([value & (1 << 64) - 1], dtype=np.uint64))[0])


def plain_entries(text):
    """Distinct words, and beginnings of so many characters with the number of different words that share them."""
    words = {w for w in re.findall(rb"[0-9a-z\x80-\xff]+", bytes(W.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]))}
    found = {hashed(w) >> 64 - T.BUCKETS for w in words}
    for n in T.BEGINNINGS:
        heads = Counter("".join(w.decode()[:n]).encode() for w in words if len(w.decode()) >= n)
        for head, different in heads.items():
            name = mixed(hashed(head) + n) >> 20 << 20
            found |= {mixed(name + d) >> 64 - T.BUCKETS for d in range(1, min(different, T.DIFFERENT) + 1)}
    return found


def test_entries_of_texts():
    texts = corpus(60)
    doc, entry = T.entries(*batch_of(texts))
    for i, text in enumerate(texts):
        assert set(entry[doc == i].tolist()) == plain_entries(text), text


def test_class_counts(spark):
    texts = corpus()
    label = [i % 3 == 0 for i in range(len(texts))]
    rows = spark.createDataFrame([(t, int(y)) for t, y in zip(texts, label, strict=True)], "text string, label int").repartition(4)
    for module, name, schema, own in ((T, "toxic", "entry int, toxic int, n int", plain_entries), (Q, "good", "gram int, good long, n long", lambda t: set(Q.forms(*batch_of([t]))[1].tolist()))):
        key = schema.split()[0]
        got = {r[key]: (r[name], r["n"]) for r in rows.mapInArrow(module._counts, schema).groupBy(key).agg(F.sum(name).alias(name), F.sum("n").alias("n")).collect()}
        n, marked = Counter(), Counter()
        for text, y in zip(texts, label, strict=True):
            n.update(own(text))
            marked.update(own(text) if y else ())
        assert got == {k: (marked[k], n[k]) for k in n}


def test_all_labels_teach_whatever_is_sent(spark):
    docs = spark.range(3000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("x").alias("label"))
    labels = spark.range(0, 3000, 2).select(F.col("id").alias("doc_id"), (F.col("id") % 4 / 2).cast("int").alias("toxic"), F.lit("y").alias("text"))
    labels = labels.union(spark.createDataFrame([(2, 0, "y"), (4, None, "y"), (None, 1, "y"), (6, 5, "y")], "doc_id long, toxic int, text string"))
    want = Counter((r[0], f"t{r[0]}", r[1]) for r in labels.where("doc_id <> 2 AND toxic IN (0, 1)").where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", "toxic").collect())
    for sent in (0, 1 << 20):
        assert Counter(map(tuple, taught(docs, labels, "toxic", 3, 1, sent).collect())) == want
    plans = [taught(docs, labels, "toxic", 3, 1, sent)._jdf.queryExecution().toString() for sent in (0, 1 << 20)]
    assert "BroadcastHashJoin" not in plans[0] and "BroadcastHashJoin" in plans[1]


def test_firing_patterns():
    lookup = np.array([-1, 0, 1, -1, 13, 25])
    rows = [[], [0, 3], [1], [1, 2, 4, 5], [2, 5]]
    table = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([0] * 5), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "label", "places"])
    (out,) = T._patterns(lookup)([table])
    for places, pattern, kept in zip(rows, out["pattern"].to_pylist(), out["places"].to_pylist(), strict=True):
        chosen = [int(lookup[p]) for p in places if lookup[p] >= 0]
        bits = {c % T.LEXICONS for c in chosen} | {T.LEXICONS + i for i, n in enumerate(T.AT_ONCE) if len(chosen) >= n}
        assert kept == chosen and pattern == sum(1 << b for b in bits)


def nothing_near_is_lower(objective, weight, slack):
    draw, least = np.random.default_rng(3), objective(weight)
    return all(objective(weight + draw.normal(size=len(weight)) * size * (draw.random(len(weight)) < 0.3)) >= least - slack for size in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_logistic_and_hinge_end_at_their_minimum():
    draw = np.random.default_rng(4)
    rows = [np.flatnonzero(draw.random(12) < 0.3) for _ in range(300)]
    true = draw.normal(size=12)
    label = np.array([int(true[r].sum() + 0.3 * draw.normal() > 0) for r in rows])
    known = np.where(np.arange(12) < 2, 1.0, 0.0)

    def loss(weight):
        margin = np.array([weight[-1] + weight[r].sum() for r in rows])
        return (np.logaddexp(0, margin) - label * margin).sum() + 0.5 * np.abs(weight[:-1] - known).sum()

    assert nothing_near_is_lower(loss, T.logistic(rows, label.astype(float), known, rounds=5000), 1e-2)
    ratio = draw.normal(size=12)
    rows = [r for r in rows if len(r)]
    label = label[:len(rows)]
    sign = np.where(label == 1, 1, -1)
    bound = 0.5 / np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    unit = [ratio[r] / math.sqrt((ratio[r] ** 2).sum()) for r in rows]

    def hinge_loss(weight):
        margin = np.array([weight[r] @ x + weight[-1] for r, x in zip(rows, unit, strict=True)])
        return (weight ** 2).sum() / 2 + (bound * np.maximum(0, 1 - sign * margin)).sum()

    assert nothing_near_is_lower(hinge_loss, Q.hinge(rows, label, ratio, rounds=400), 1e-2)


def test_scores_follow_from_the_weights(spark):
    texts = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int("$" in t), int("idiot" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    kept, weight, intercept = T.fit(docs, labels)
    of = dict(zip(kept.tolist(), weight, strict=True))
    for r in T.toxicity(docs, labels).collect():
        want = 1 / (1 + math.exp(-(intercept + sum(of.get(e, 0.0) for e in plain_entries(r["text"])))))
        assert abs(r["score"] - want) < 1e-5 and r["predicted"] == (r["score"] >= 0.7)
    ratio, weight, slope, shift = Q.fit(docs, labels)
    for r in Q.quality(docs, labels).collect():
        grams = set(Q.forms(*batch_of([r["text"]]))[1].tolist())
        length = math.sqrt(sum(ratio[g] ** 2 for g in grams))
        margin = sum(ratio[g] * weight[g] for g in grams) / max(length, 1e-12) + weight[-1]
        assert abs(r["score"] - 1 / (1 + math.exp(-(slope * margin + shift)))) < 1e-4
