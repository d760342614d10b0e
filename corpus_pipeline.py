"""A corpus pipeline of five stages over ``documents``; each stage works on all rows the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwise.llm.decontaminate import decontaminate
from poolwise.llm.jaccard_join import jaccard_components
from poolwise.llm.mixing import mix
from poolwise.llm.scratch import Scratch, keyed
from poolwise.llm.secrets import redacted, secret_spans
from poolwise.llm.toxicity import toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.  Their labels teach where the rule of op5 allows it.

    Null and empty texts hold no marker and stay; repeated rows score alike and stay or go together.
    """
    scored = toxicity(docs.select("doc_id", "text", F.struct("*").alias("row")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, the one with the smallest doc_id; all without words.

    Rows alike in doc_id and text are one group, of which one stays; null and empty texts have no words.  In a table with
    repeated or null doc_ids the row that stays is named by a hash of doc_id and text.
    """
    found = jaccard_components(docs).where("keeper")
    kept = found.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.max(F.col("n_shingles") == 0).alias("empty"))
    rows = keyed(docs, F.struct("*").alias("row")).join(kept.hint("merge"), "key")
    if kept.where("copies > 1 AND NOT empty").limit(1).count():  # rows alike in doc_id and text are one group too
        rows = rows.where("NOT empty").dropDuplicates(["key"]).union(rows.where("empty"))
    return rows.select("row.*")


def unpolluted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null and empty texts hold none, repeated rows go together."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))
    found = decontaminate(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["row"])
    return found.where("NOT contaminated").select("row.*")


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows.  Null texts stay null; texts without a secret stay as they are."""
    found = secret_spans(docs.select("text", F.struct("*").alias("row")))
    text = F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("spans")))
    found = found.select("row", F.col("spans"), text.alias("clean"))
    fresh = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("clean")).cast("long")}
    return found.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; null texts have size 0, repeated rows are mixed each on its own."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", civil), ("near duplicates", distinct), ("decontamination", unpolluted), ("secrets", redaction), ("mixing", mixed)]

#: SQL cannot train the toxicity stage; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
