"""Exact top-k search, conversation repair and the filter audit against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwise.llm import filter_audit as audit_module
from poolwise.llm.conversation_repair import Automaton, conversation_repair, repair
from poolwise.llm.filter_audit import failures, filter_audit, positional_counts
from poolwise.llm.top_scores import top_scores

WHITE = " \t\n\x0b\x0c\r"


def best_scores(rows, k, divisor, scale):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, v in usable:
        if i % divisor == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v))
            out.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k]))
    return out


@pytest.mark.parametrize(("scale", "block", "k"), [(256, 4096, 5), (3, 4, 5), (1 << 25, 7, 3), (256, 50, 1000)])
def test_top_scores(spark, scale, block, k):
    draw = random.Random(scale)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # ties far beyond k
    rows += [(400, None), (402, [1.0, None] * 3), (404, [float("nan")] * 6), (406, [float("-inf")] * 6), (408, []), (410, []), (412, [0.0] * 6), (414, [1.0, 2.0]),
             (None, [9.0] * 6), (8, rows[5][1]), rows[10], rows[10], (-6, [-1.0] * 6)]
    table = spark.createDataFrame([(i, v, "x", 0, "y") for i, v in rows], "vec_id long, embedding array<double>, score string, rank int, query_id string").repartition(5)
    got = top_scores(table, F.col("vec_id") % 2 == 0, k, scale, block)
    assert Counter(map(tuple, got.collect())) == best_scores(rows, k, 2, scale)
    assert [f.simpleString() for f in got.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:bigint"]
    if block == 4096:
        assert top_scores(table.limit(0), F.lit(True)).count() == 0
        assert top_scores(table, F.lit(False)).count() == 0


def test_scores_that_fit_no_long_end_the_job(spark):
    with pytest.raises(ValueError, match="fit"):
        top_scores(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>"), F.lit(True))


def damaged_rows(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired lines) by search from the start in order of cost, then audit."""
    moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    renamed = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    queue, settled = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, place, state, lines = heapq.heappop(queue)
        if place == len(rows) and state in (0, 3):
            return cost, audit, lines
        if (place, state) in settled:
            continue
        settled.add((place, state))
        role, after = renamed[state]
        heapq.heappush(queue, (cost + 5, audit + "I", place, after, (*lines, f"{role}:")))
        if place < len(rows):
            (_, own, text), fault = rows[place], faults[place]
            heapq.heappush(queue, (cost + 2, audit + "D", place + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                heapq.heappush(queue, (cost + extra + 1, audit + "R", place + 1, after, (*lines, f"{role}:{text}")))
                if state in moves.get(own[:1], {}):
                    heapq.heappush(queue, (cost + extra, audit + "K", place + 1, moves[own[0]][state], (*lines, f"{own}:{text}")))


def brute_repair(by):
    want = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "none" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(rows, faults)
        want[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def conversations():
    draw = random.Random(5)
    texts = ["Hi.", "Well", "Why?", "no\t\n", "  ", "\x0b\x0c\r", "", "Ends! \n", "é　", None, "a\nb.", "1!", "2?", "3.", "4.", "5", "6.", "7."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "admin", "Robot"]
    rows = []
    for conv in range(260):
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if draw.random() < 0.05 else turn * draw.choice((1, 1, 2)) - 1, role, draw.choice(texts)))
    rows += [(None, t, "user", "x.") for t in (1, 2, None, None)] + rows[:20]
    rows += [(1000, t, ("user", "assistant")[t % 2], draw.choice(texts[:3])) for t in range(3000)]
    return rows


def test_conversation_repair(spark):
    rows = conversations()
    by = damaged_rows(rows)
    by.update({conv: [] for conv, *_ in rows if conv not in by})
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string").repartition(7)
    got = conversation_repair(table).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_repair(by) and len(got) == len(by)
    assert any("D" in r["audit"] and "R" in r["audit"] for r in got)
    assert conversation_repair(table.limit(0)).count() == 0


def test_conversation_of_one_row_repeated(spark):
    rows = spark.range(20_000, numPartitions=6).select(F.lit("c").alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("x.").alias("text"),
                                                        F.lit(0).alias("copy"), F.lit(False).alias("gone"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = repair(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1
    r = got[0]
    assert (r["gaps"], r["duplicate"], r["illegal"], r["cost"], r["audit"]) == (0, 19_999, 19_999, 40_000, "D" * 20_000)


def test_automaton_shares_endings():
    automaton = Automaton()
    words = sorted(("aeig", "eieig", "g", "", "eig", "eeig"), key=lambda w: w[::-1])
    made = []
    plain = Automaton.node
    Automaton.node = staticmethod(lambda *a: made.append(a) or plain(*a))
    try:
        found = {w: automaton.read(w) for w in words}
    finally:
        Automaton.node = staticmethod(plain)
    assert len(made) == len({w[i:] for w in words for i in range(len(w))})
    assert all(found[w] == Automaton().read(w) for w in words) and found[""] == (0, "")


def brute_audit(docs, labels):
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[place] == 1} for place in (1, 2))
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first.get(text, i) < i}
        parts[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    want, share = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                removed = [r for r in rows if f in r[0] and not r[0] & before]
                kept = sum(not r[0] & (before | {f}) for r in rows)
                share[part, f] += len(removed)
                want[part, "".join(order), step + 1] = [kept, len(removed), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows),
                                                        sum(r[1] for r in removed), sum(r[2] for r in removed)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_filter_audit(spark):
    draw = random.Random(9)
    words = [draw.choice(("", "Ab", "É", "x$", "|")) * (draw.random() < 0.1) + "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 4))) for _ in range(400)]
    docs = [(i, draw.choice((" ", "\n", "　 ")).join(draw.choice(words) for _ in range(draw.choice((5, 99, 100, 101, 300)))), draw.choice(("en", "de", None, "")), 1, "z") for i in range(150)]
    docs += [(500 + i, docs[i % 9][1], draw.choice(("en", "fr")), 1, "z") for i in range(60)]
    docs += [(600, None, "en", 1, "z"), (601, "", "en", 1, "z"), (602, " \t", None, 1, "z"), (None, docs[0][1], "en", 1, "z"), (None, None, "xx", 1, "z"), docs[0], docs[160], (0, "other", "de", 1, "z"),
             (700, " ".join(f"w{i}" for i in range(60_000)), "long", 1, "z"), (701, "A" * 50_000, "long", 1, "z")]
    labels = [(i, draw.choice((0, 1, None)), draw.choice((0, 1, None))) for i in range(0, 620, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept int, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(table, marks)
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == brute_audit(docs, labels)
    assert filter_audit(table.limit(0), marks).count() == 0
    assert filter_audit(table, marks.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_pieces_of_a_long_text_say_the_same(monkeypatch):
    text = ("Ab c d " * 40 + "$ " + "q" * 300 + "\n" + " ".join(f"w{i}" for i in range(200))).encode()
    whole = failures(text, 900)
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(audit_module, "PIECE", size)
        assert failures(text, 900) == whole
    assert failures(b"", 0) == 1


def test_positional_counts_add_words_by_weight():
    draw = np.random.default_rng(1)
    for size in (0, 1, 2, 3, 4, 1000):
        words, weights = draw.integers(0, 1 << 32, size, dtype=np.uint32), draw.integers(0, 50, size)
        assert positional_counts(words, weights).tolist() == [int((weights * (words >> np.uint32(i) & 1)).sum()) for i in range(32)]
