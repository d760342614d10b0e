"""Labelled documents for fitting: which rows may teach, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


#: Bytes of doc_id and label that are sent to all tasks; more labels than that meet their texts in a shuffle.
SENT = 64 << 20


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def taught(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, sent: int = SENT) -> DataFrame:
    """(doc_id, text, label) of all rows with a label 0 or 1 whose remainder is not ``held``.

    Labels that contradict each other teach nothing; a null doc_id has none.  Labels of up to ``sent`` bytes are sent to the
    texts, so no text is shuffled; beyond that both sides are shuffled by doc_id.  The rows are the same.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")
    marks = marks.where(remainder(F.col("doc_id"), modulus) != held)
    marks = F.broadcast(marks) if 12 * marks.count() <= sent else marks.hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where(remainder(F.col("doc_id"), modulus) != held).join(marks, "doc_id").select("doc_id", "text", "label")


def sampled(rows: DataFrame, total: int, most: int, salt: int = 7) -> DataFrame:
    """About ``most`` of the rows by a hash of their doc_id: the same ones on every run, a uniform share of all.

    A sample of a sample needs a ``salt`` of its own, or it takes again what the first one took.
    """
    share = min(1.0, most / max(1, total))
    return rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))
