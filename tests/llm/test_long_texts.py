"""Texts longer than a chunk: the same answers as brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolwise.llm import quality as Q, toxicity as T, words as W
from poolwise.llm.jaccard_join import jaccard_components
from poolwise.llm.substring_windows import repeated_windows
from poolwise.llm.suffix_dedup import suffix_dedup


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(21)
    words = ["".join(draw.choice("abcdefgé") for _ in range(draw.randint(2, 8))) for _ in range(4000)]
    base = [draw.choice(words) for _ in range(70_000)]
    near = list(base)
    for i in range(0, 70_000, 700):
        near[i] = "changed"
    short = base[30_000:30_090]
    out = [" ".join(base), " ".join(near), " ".join(short), " ".join(draw.choice(words) for _ in range(60_000)) + " " + " ".join(base[:40]), "tail " * 3]
    assert len(out[0].encode()) > 1.3 * W.CHUNK and len(out[3].encode()) > W.CHUNK
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


def test_jaccard(docs, texts):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.encode().split() for t in texts)]
    links = [(a, b) for a in range(5) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert links == [(1, 0)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == {i: (len(s), 0 if i == 1 else i) for i, s in enumerate(sets)}


def test_repeated_windows(docs, texts):
    words = [t.encode().split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p:p + 13]), i)
    for r in repeated_windows(docs).collect():
        w, hit = words[r["doc_id"]], set()
        for p in range(len(w) - 12):
            if first[tuple(w[p:p + 13])] < r["doc_id"]:
                hit |= {*range(p, p + 13)}
        assert r["n_words"] == len(w) and r["kept"] == b" ".join(x for i, x in enumerate(w) if i not in hit).decode()
        assert hit or r["doc_id"] in (0, 4)


def test_suffixes(docs, texts):
    data = [t.encode() for t in texts]
    met = Counter(b[p:p + 400] for b in data for p in range(len(b) - 399))
    for r in suffix_dedup(docs).collect():
        b = data[r["doc_id"]]
        depth = np.zeros(len(b) + 1, dtype=np.int64)
        for p in range(len(b) - 399):
            if met[b[p:p + 400]] > 1:
                depth[p] += 1
                depth[p + 400] -= 1
        hit = np.cumsum(depth[:-1]) > 0
        assert bytes(r["kept"]) == np.frombuffer(b, dtype=np.uint8)[~hit].tobytes() and r["n_bytes"] == len(b)


def test_entries_and_forms_do_not_depend_on_the_neighbours(texts):
    """A long text gives the same entries alone and between others."""
    def by_text(kernel, some):
        batch = pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["text"])
        out = []
        for rows, buf, off in W.chunks(batch):
            doc, name = kernel(buf, off)
            out += [set(name[doc == i].tolist()) for i in range(len(rows))]
        return out

    for kernel in (T.entries, Q.forms):
        together = by_text(kernel, ["one two", *texts, "", "three"])
        assert together[1:-2] == [by_text(kernel, [t])[0] for t in texts] and all(together[1:6])
    seen = by_text(T.entries, [texts[3]])[0]
    for word in {*texts[3].split()}:
        data = np.frombuffer(word.encode(), dtype=np.uint8)
        assert int(W.range_hash(W.prefix_sums(data), np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - T.BUCKETS)) in seen
