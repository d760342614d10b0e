"""The pipeline's stages on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "key string, row string, spans string, score double, copies string"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Labels and a benchmark of their own."""
    path = tmp_path_factory.mktemp("stages")
    passage = " ".join(f"leak{i}" for i in range(12))
    spark.createDataFrame([(1, passage), (2, None), (None, "solo")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    toxic = [(i, 1, int(i % 4 == 0)) for i in range(0, 400)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def rows():
    passage = " ".join(f"leak{i}" for i in range(12))
    clean = [f"document number {i} speaks of {'rivers' if i % 2 else 'hills'} and word{i} other{i} more{i} last{i} in its own way {i * 7} times" for i in range(400)]
    texts = [(i, t + (" you stupid idiot and pathetic scum" if i % 4 == 0 else "")) for i, t in enumerate(clean)]
    texts += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, clean[1]), (1004, clean[1] + " extra"), (1005, f"before {passage} after"), (1006, "solo"),
              (1007, "password = 'abcdefgh12' and text"), (1008, "word " * 60_000), (1009, clean[3]), (1009, clean[3]), (None, clean[7]), (None, None), (3, "another text under an old id")]
    return [(i, t, "en", ["a", "b", None][(i or 0) % 3], len(t or ""), "k", "r", "s", 0.5, "c") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, f"{COLUMNS}, {CLASHES}").repartition(4).cache()


def counted(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", list(STAGES)[:4])
def test_stage_keeps_columns_and_takes_empty_tables(spark, docs, place, name):
    out = STAGES[name](spark, docs, place)
    assert out.columns == docs.columns and counted(out) - counted(docs) == Counter() or name == "secrets"
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert out.where("key <> 'k' OR row <> 'r' OR spans <> 's' OR score <> 0.5 OR copies <> 'c'").count() == 0
    assert STAGES[name](spark, docs.limit(0), place).count() == 0


def test_toxic_documents_go(spark, docs, place):
    kept = counted(STAGES["toxicity"](spark, docs, place))
    gone = counted(docs) - kept
    assert len(gone) >= 95 and all("idiot" in t for _, t in gone)
    assert all("idiot" not in (t or "") or n == 0 for (_, t), n in kept.items())
    assert kept[None, None] == kept[1000, None] == kept[1001, ""] == 1 and sum(n for (i, _), n in kept.items() if i == 1009) == 2


def test_one_of_each_group_stays(spark, docs, place):
    kept = counted(STAGES["near duplicates"](spark, docs, place))
    groups = defaultdict(int)
    for (_, t), n in kept.items():
        for mark in ("word1 ", "word3 ", "word7 "):
            groups[mark] += n * (mark in (t or ""))
    assert set(groups.values()) == {1} and max(kept.values()) == 1
    assert kept[1000, None] == kept[None, None] == kept[1001, ""] == kept[1002, " \n\t"] == 1


def test_documents_with_passages_go(spark, docs, place):
    gone = counted(docs) - counted(STAGES["decontamination"](spark, docs, place))
    assert set(gone) == {r[:2] for r in docs.where("doc_id IN (1005, 1006)").select("doc_id", "text").collect()}


def test_secrets_are_marked(spark, docs, place):
    out = {(r["doc_id"], r["text"]): r["n_chars"] for r in STAGES["secrets"](spark, docs, place).collect()}
    assert out[1007, "[secret]' and text"] == 18 or any(i == 1007 and "[secret]" in t and "abcdefgh12" not in t for i, t in out)
    assert sum(STAGES["secrets"](spark, docs, place).count() for _ in range(1)) == docs.count() and (1000, None) in out


def test_mix_takes_targets(spark, docs, place):
    out = STAGES["mixing"](spark, docs, place).collect()
    assert len(out) == docs.count()
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in out)
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(min(total, sum(3 * own[0]["source_size"] for own in by.values())))
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3 * max(r["size"] for r in own)
    assert STAGES["mixing"](spark, docs.limit(0), place).count() == 0
