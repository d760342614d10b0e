"""Written intermediate tables with an owner: gone when the operator ends, but for its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwise.runtime import scratch_path

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the cluster's shared folder.

    ``write`` cuts the lineage: a lost executor later costs a reread, no recomputation, and the shuffle files
    of each step go as soon as its table is there.  ``keep`` writes what the operator returns.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()
        self.of: dict[int, tuple[str, DataFrame]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            if path not in self.kept:
                self.delete(path)

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.of[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``write`` before the end, once nothing reads them any more."""
        for table in tables:
            path = self.of.pop(id(table))[0]
            self.paths.remove(path)
            self.delete(path)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        out = self.write(df, label)
        self.kept.add(self.paths[-1])
        return out


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text, ``more`` columns and ``key``, which names a row: the doc_id itself where no two rows share it and none is null,
    else a hash of doc_id and text.  Rows alike in both are one key and get the same answers."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    return docs.withColumn("key", F.xxhash64("doc_id", "text") if odd else F.col("doc_id"))
