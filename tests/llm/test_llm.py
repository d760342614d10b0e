"""The training-data operators against brute force, their tokenizer's own library, SQL and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from poolwise.llm import jaccard_join, secrets  # noqa: E402
from poolwise.llm.decontaminate import decontaminate  # noqa: E402
from poolwise.llm.graph import components  # noqa: E402
from poolwise.llm.hnsw import Graph  # noqa: E402
from poolwise.llm.jaccard_join import jaccard_components  # noqa: E402
from poolwise.llm.labelled import sampled  # noqa: E402
from poolwise.llm.mixing import mix, targets  # noqa: E402
from poolwise.llm.quality import quality  # noqa: E402
from poolwise.llm.queries import ORACLES, QUERIES  # noqa: E402
from poolwise.llm.scratch import Scratch  # noqa: E402
from poolwise.llm.substring_windows import repeated_windows  # noqa: E402
from poolwise.llm.suffix_dedup import suffix_dedup  # noqa: E402
from poolwise.llm.token_counts import token_counts  # noqa: E402
from poolwise.llm.toxicity import label_model, toxicity  # noqa: E402
from poolwise.llm.vector_dups import vector_components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, score string, spans string"


def corpus() -> list[tuple]:
    """Nulls, empty and long texts, near and exact copies, repeated rows, shared passages, unusual characters."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 120))) for _ in range(40)]
    passage = " ".join(draw.choice(words) for _ in range(40))
    for i in range(12):
        base = texts[i % 4].split()
        for _ in range(draw.randint(0, 3)):
            base[draw.randrange(len(base))] = draw.choice(words)
        texts.append(" ".join(base))
        texts.append(f"{texts[20 + i]} {passage}\n{texts[8 + i]}")
    texts += [None, "", " \t\n", "one", "One TWO", "one two", passage, passage.upper(), "x" * 30_000, "ab " * 4000,
              "token=abcdefgh1 x <|endoftext|> don't　y\x1cz", "İ ſecret: 12345678  𝄞 secret=\"abcd/efgh\""]
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], 0, "clash", 1, "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[5], None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_token_counts_match_the_library(docs, rows, empty):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in rows)
    assert counted(token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts(empty, path).count() == 0


def brute_marks(text, items):
    word = re.compile(rb"[0-9a-z\x80-\xff]+").findall
    words = word((text or "").encode().lower())
    hit, found = set(), set()
    for item, t in items:
        own = word((t or "").encode().lower())
        m = min(10, len(own))
        for s in range(len(own) - m + 1 if own else 0):
            for p in range(len(words) - m + 1):
                if words[p:p + m] == own[s:s + m]:
                    hit |= {*range(p, p + m)}
                    found |= set() if item is None else {str(item)}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontamination(spark, docs, rows, empty, block_bytes):
    items = [(1, rows[0][1]), (2, rows[41][1]), (10, "ONE two"), (2, rows[1][1]), (None, rows[2][1]), (4, None), (5, "..."), (6, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((r[0], n, h, tuple(f), h > 0) for r in rows for n, h, f in [brute_marks(r[1], items)])
    got = decontaminate(docs, bench, block_bytes=block_bytes).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert Counter((r[0], r[1], r[2], tuple(r[3]), r[4]) for r in got) == want
    assert decontaminate(empty, bench, block_bytes=block_bytes).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_components(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows)), len(ids)


@pytest.mark.parametrize("options", [{}, {"pivot_rounds": 0, "frequent": 0}])
def test_jaccard_components(docs, rows, empty, options):
    want, groups = brute_components(rows)
    found = jaccard_components(docs, **options)
    assert counted(found, "doc_id", "n_shingles", "component_id") == want
    assert found.where("keeper AND n_shingles > 0").select("key").distinct().count() + found.where("n_shingles = 0").count() == groups
    if not options:
        assert jaccard_components(empty).count() == 0


def test_jaccard_plan_switches_change_no_row(docs, rows, monkeypatch):
    want, _ = brute_components(rows)
    monkeypatch.setattr(jaccard_join, "FETCHED", 0)
    monkeypatch.setattr(jaccard_join, "COUNTED", 40)
    assert counted(jaccard_components(docs, frequent=30), "doc_id", "n_shingles", "component_id") == want


def test_secrets_match_sql(spark, docs, empty):
    more = [(1000 + i, t, None, None, None, None, None, None, None) for i, t in enumerate([
        "key Xk9Qw2Lp8Zt4Rv7Bn1Mc6Yd3Hf5Jg0Ss end", "A1B2C3D4E5F60718293A4B5C6D7E", "AKIAABCDEFGHIJKL12 AKIAxx AKIA", "ééé passwd : 'zzzzzzzzzz' é",
        "0123456789abcdef0123456789abcdef0123", "apikey=short token: password:abcdefgh1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1",
        "Qm9vVGhpcyBpcyBhIHRlc3Qgc3RyaW5nIHdpdGggYmFzZTY0IQ==/" * 3, "some/path/of-words/that_is/quite/long/indeed", "API_KEY = abc.def-ghi_jkl"])]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    found = secrets.secret_spans(both)
    table = both.select("doc_id", "text").toPandas()  # noqa: F841  read by the SQL below
    base = duckdb.connect()
    base.register("documents", table)
    want = Counter(tuple(None if x != x else x for x in r) for r in base.sql(f"SELECT doc_id, base_sha256, spans FROM ({secrets.oracle()})").df().astype(object).values.tolist())
    assert counted(found.select("doc_id", F.sha2(secrets.listed("base"), 256), secrets.listed("spans")), "*") == want
    kinds = {s["kind"] for r in found.collect() for s in r["spans"]}
    assert kinds == {"assign", "access", "hex", "entropy_hex", "entropy_base64"}
    clean = found.select(secrets.redacted(F.col("text"), F.col("spans"), "*").alias("text"))
    assert secrets.secret_spans(clean).where("size(base) > 0").count() == 0
    assert secrets.secret_spans(empty).count() == 0


def brute_windows(rows, size):
    words = [(r[1] or "").encode().split() for r in rows]
    first = {}
    for r, w in zip(rows, words, strict=True):
        for p in range(len(w) - size + 1):
            if r[0] is not None:
                first[tuple(w[p:p + size])] = min(r[0], first.get(tuple(w[p:p + size]), r[0]))
    out = Counter()
    for r, w in zip(rows, words, strict=True):
        hit = set()
        for p in range(len(w) - size + 1):
            if r[0] is not None and first[tuple(w[p:p + size])] < r[0]:
                hit |= {*range(p, p + size)}
        out[r[0], len(w), b" ".join(x for i, x in enumerate(w) if i not in hit).decode()] += 1
    return out


@pytest.mark.parametrize(("size", "gram"), [(13, 5), (4, 4), (6, 1)])
def test_repeated_windows(docs, rows, empty, size, gram):
    assert counted(repeated_windows(docs, size, gram), "doc_id", "n_words", "kept") == brute_windows(rows, size)
    if size == 13:
        assert repeated_windows(empty).count() == 0


@pytest.mark.parametrize(("size", "q", "width"), [(40, 20, 16), (30, 7, 5)])
def test_suffix_dedup(docs, rows, empty, size, q, width):
    texts = [(r[0], (r[1] or "").encode()) for r in rows if r[1] is None or len(r[1]) < 5000]
    met = Counter(b[p:p + size] for _, b in texts for p in range(len(b) - size + 1))
    want = Counter()
    for i, b in texts:
        hit = {j for p in range(len(b) - size + 1) if met[b[p:p + size]] > 1 for j in range(p, p + size)}
        want[i, len(b), sum(j - 1 not in hit for j in hit), bytes(x for j, x in enumerate(b) if j not in hit)] += 1
    cut = suffix_dedup(docs.where("text IS NULL OR length(text) < 5000"), size, q, width)
    got = Counter((r[0], r[1], r[2], bytes(r[3])) for r in cut.select("doc_id", "n_bytes", F.size("starts"), "kept").collect())
    assert got == want
    assert suffix_dedup(empty).count() == 0


def test_mixing(spark, docs, rows, empty):
    out = mix(docs).collect()
    assert len(out) == len(rows) and out == mix(docs).collect() or Counter(out) == Counter(mix(docs).collect())
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3 * max(r["size"] for r in own)
    assert mix(empty).count() == 0
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(sizes).collect()}
    assert got == {"a": 740.0, "b": 30.0, "c": 0.0, None: 740.0}


def test_vectors(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(300, 8))
    near = np.repeat(base[:20], 6, axis=0) + 0.03 * draw.normal(size=(120, 8))
    data = np.concatenate((base, near, base[:5], base[:1]))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] * 4), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r for r in vector_components(table).collect()}
    assert sum(got[i]["n_links"] for i in range(len(data))) >= 0.9 * links.sum()
    assert all(got[i]["n_links"] <= links[i].sum() for i in range(len(data)))
    assert all(got[i]["component_id"] <= i for i in range(len(data)))
    assert [got[i]["n_links"] for i in (900, 901, 902, 903, 904, 905, 906, 907)] == [0, 0, 0, 0, 0, 1, 1, 0]
    assert got[906]["component_id"] == 905 and got[900]["kept"] and not got[906]["kept"]
    assert vector_components(table.limit(0)).count() == 0
    twice = vector_components(table.union(table.where("vec_id = 905")))
    assert counted(twice.where("vec_id = 905"), "n_links") == Counter({(2,): 2})


def test_graph_widens_until_the_audit_passes():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    data = np.repeat(centres, 60, axis=0) + 0.05 * draw.normal(size=(2400, 16))
    unit = (data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.float32)[draw.permutation(2400)]
    graph = Graph(unit, beam=4)
    assert graph.audit(0.95, 300, 0.97) >= 0.97
    true = int((unit @ unit.T >= 0.95).sum())
    assert len(graph.similar(unit, 0.95)[0]) >= 0.95 * true


def test_audit_counts_no_self_pairs_and_asks_from_everywhere():
    draw = np.random.default_rng(4)
    data = draw.normal(size=(2000, 16))
    data[-10:] = data[100:110] + 0.02 * draw.normal(size=(10, 16))  # pairs, of which the second is linked by nobody
    unit = (data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.float32)

    def unlinked():
        graph = Graph(unit)
        graph.levels[-1][graph.levels[-1] >= 1990] = -1
        return graph

    own = unlinked()
    assert own.audit(0.95, 1000, 0.97) >= 0.97
    query, node = own.similar(unit, 0.95)
    assert own.beam != 48 and (query != node).sum() == (unit @ unit.T >= 0.95).sum() - 2000
    asked = unlinked()
    assert asked.audit(0.95, 0, 0.97, unit[100:110]) >= 0.97 and asked.beam != 48


def test_audit_without_pairs_asks_for_nearest_neighbours():
    draw = np.random.default_rng(6)
    data = draw.normal(size=(3000, 12))
    unit = (data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.float32)
    graph = Graph(unit)
    assert 0.9 <= graph.audit(0.9999, 500, 0.97) <= 1.0
    poor = Graph(unit, beam=2)
    poor.levels[-1][:, 3:] = -1  # few links: a narrow beam misses most neighbours
    assert poor._neighbours_met(unit[:500], np.arange(500), np.sort(unit[:500] @ unit.T, axis=1)[:, -2]) < 0.9
    assert poor.audit(0.9999, 500, 0.97) >= 0.9 and poor.beam != 2
    assert Graph(unit[:1]).audit(0.9, 10, 0.97) == 1.0


def test_vector_components_are_those_of_all_links(spark):
    draw = np.random.default_rng(8)
    chain = [[math.cos(0.2 * i), math.sin(0.2 * i)] for i in range(12)]  # neighbours link, ends do not
    far = draw.normal(size=(60, 9))
    rows = [(50 + i, v) for i, v in enumerate(chain)] + [(100 + i, v.tolist()) for i, v in enumerate(far)] + [(None, chain[3]), (None, None), (None, [0.0, 0.0]), (7, chain[11]), (7, chain[11])]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, kept string")
    units = [np.array(v) / np.linalg.norm(v) if v is not None and np.linalg.norm(v) else None for _, v in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i, u in enumerate(units):
        for j, w in enumerate(units):
            if i != j and u is not None and w is not None and len(u) == len(w) and u @ w >= 0.95:
                links[i] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    want = Counter((r[0], links[i], least.get(root(i))) for i, r in enumerate(rows))
    for options in ({}, {"block_bytes": 200, "shards": 3}):
        got = vector_components(table, **options)
        assert counted(got, "vec_id", "n_links", "component_id") == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 200), (200, 7), (9, 9)] + [(1000, 1001 + i) for i in range(300)]
    with Scratch(spark) as scratch:
        got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect())
    assert got[160] == 100 and got[7] == 5 and got[1300] == 1000 and 9 not in got and len(got) == 61 + 3 + 301


def test_label_model_discounts_copies_of_a_voter():
    draw = np.random.default_rng(0)
    y = draw.random(4000) < 0.3
    fire = lambda hit, false: np.where(y, draw.random(4000) < hit, draw.random(4000) < false)
    a, b, c = fire(0.8, 0.05), fire(0.7, 0.1), fire(0.6, 0.3)
    votes = np.stack((a, b, c, c, c, c), axis=1).astype(int)
    posterior, rate, correlation = label_model(votes, np.where(draw.random(4000) < 0.05, ~y, y).astype(int), np.ones(4000))
    assert ((posterior > 0.5) == y).mean() > 0.93
    assert correlation[2, 3] > 0.9 > 0.5 > abs(correlation[0, 1]) and rate[1, 0] > 0.6 > rate[0, 0]


def test_a_sample_of_a_sample_is_bounded(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "doc_id")
    first = sampled(rows, 100_000, 10_000)
    total = first.count()
    assert 9_500 < total < 10_500
    for salt in (11, 13, 17):
        assert 4_500 < sampled(first, total, 5_000, salt).count() < 5_500


def held(scored, labels, column):
    joined = scored.where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    return np.array([r[0] for r in joined]), np.array([r[1] for r in joined])


def test_toxicity_and_quality_on_held_out_labels(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for operator, column, modulus, rest in ((toxicity, "toxic", 3, 1), (quality, "quality", 4, 2)):
        scored = operator(table, labels).cache()
        predicted, true = held(scored, labels, column)
        assert (predicted == true).mean() > 0.93
        assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
        for r in scored.select("doc_id", "held_out").limit(50).collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        odd = operator(docs, labels.limit(0))
        assert odd.count() == docs.count() and odd.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
        assert operator(docs, labels).where("score IS NULL").count() == 0
        assert operator(empty, labels).count() == 0


def test_toxicity_finds_markers_of_every_language(spark):
    sf_dir = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity(table, labels).where("held_out").join(labels, "doc_id").groupBy("lang", "toxic").agg(F.sum("predicted").alias("hit"), F.count(F.lit(1)).alias("n")).collect()
    found = {(r["lang"], r["toxic"]): (r["hit"], r["n"]) for r in rows}
    for lang in ("en", "de", "fr", "es"):
        hit, n = found[lang, 1]
        assert hit >= 0.85 * n, (lang, hit, n)
        hit, n = found[lang, 0]
        assert hit <= 0.05 * n, (lang, hit, n)


def test_pipeline_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        path = str(tmp_path / str(place))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            scored = toxicity(spark.createDataFrame(before, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert {*after} == {r["doc_id"] for r in scored.where("predicted = 0").collect()} and len(after) > 0.8 * len(before)
        elif name == "near duplicates":
            least, _ = brute_components(before)
            assert {*after} == {i for i, n, c in least if i == c}
        elif name == "decontamination":
            assert {*after} == {i for i, t in before if not brute_marks(t, items)[1]}
        elif name == "secrets":
            assert {*after} == {i for i, _ in before}
            assert secrets.secret_spans(docs).where("size(base) > 0").count() == 0
        else:
            assert {*after} == {i for i, _ in before}
        if place < 4:
            assert docs.columns == names
    assert counted(corpus_pipeline.run(spark, sf_dir), "doc_id", "taken") == counted(docs, "doc_id", "taken")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    base = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = base.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert Counter(map(tuple, got[columns].astype(object).values.tolist())) == Counter(map(tuple, want[columns].astype(object).values.tolist()))


def test_suffix_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = [(r[0], (r[1] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    met = Counter(b[p:p + 400] for _, b in texts for p in range(len(b) - 399))
    want = Counter()
    for i, b in texts:
        hit = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 399):
            if met[b[p:p + 400]] > 1:
                hit[p:p + 400] = True
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        want[i, len(b), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~hit[:-1]])).hexdigest()] += 1
    assert counted(QUERIES["op6_suffix_dedup"](spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_parities_never_rule_out_too_much():
    """The places that differ are never more than the names that differ, on equal and on folded numbers of places."""
    rng = np.random.default_rng(5)
    for m, n, shared in ((1, 1, 0), (1, 1, 1), (64, 65, 60), (200, 260, 190), (3000, 3900, 2900), (5000, 5000, 0)):
        names = rng.integers(0, 1 << 63, m + n - shared, dtype=np.int64).view(np.uint64)
        left, right = names[:m], names[m - shared:]
        differ = m + n - 2 * shared
        found = jaccard_join.apart(jaccard_join.parities(left), jaccard_join.parities(right))
        assert found <= differ and (differ - found) % 2 == 0
        assert found or not differ or differ == 2
    assert jaccard_join.apart(jaccard_join.parities(names[:0]), jaccard_join.parities(names[:0])) == 0
