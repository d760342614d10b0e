"""One query per operator, over its whole table, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwise.llm.conversation_repair import conversation_repair
from poolwise.llm.decontaminate import decontaminate
from poolwise.llm.filter_audit import filter_audit
from poolwise.llm.jaccard_join import jaccard_components
from poolwise.llm.mixing import mix
from poolwise.llm import oracles, secrets
from poolwise.llm.quality import quality
from poolwise.llm.substring_windows import repeated_windows
from poolwise.llm.suffix_dedup import suffix_dedup
from poolwise.llm.token_counts import token_counts
from poolwise.llm.top_scores import top_scores
from poolwise.llm.toxicity import toxicity
from poolwise.llm.vector_dups import vector_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(starts: str = "starts", ends: str = "ends"):
    """Total length of the ranges."""
    return F.aggregate(F.zip_with(ends, starts, lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


ORACLES |= {"op2_decontaminate": oracles.DECONTAMINATE, "op3_jaccard_join": oracles.JACCARD, "op4_secrets": secrets.oracle(),
            "op8_mix": oracles.MIX, "op9_vector_dups": oracles.VECTORS, "op10_repeated_windows": oracles.WINDOWS,
            "op11_top_scores": oracles.SCORES, "op12_conversation_repair": oracles.REPAIR, "op13_filter_audit": oracles.FILTERS}


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", removed().alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))


@query
def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_windows(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
