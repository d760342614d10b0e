"""Readers and writers: tables, result folders, model sets, and resumable sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, index_column: str | None = None) -> DataFrame:
    """Header CSV with a stated schema (S1); a written row index is dropped again (S3)."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return df.drop(index_column) if index_column else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_results(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Every CSV of a folder as one table, with the file each row came from."""
    return (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
            .withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)))


def write_csv(df: DataFrame, path: str, index_column: str | None = None, mode: str = "error") -> None:
    """Header CSV (S3); the optional index is unique but not gap-free."""
    if index_column:
        df = df.select(F.monotonically_increasing_id().alias(index_column), *df.columns)
    df.write.mode(mode).option("header", True).csv(path)


def save_model_set(path: str, outcome: str, config: str, sets: DataFrame, models: DataFrame, summary: dict) -> None:
    """Partitions, models with their members, and run parameters under (outcome, config) (S4); a rerun replaces only its own.

    Parameters are numbers or strings.
    """
    spark = sets.sparkSession
    tag = lambda df: df.withColumn("outcome", F.lit(outcome)).withColumn("config", F.lit(config))
    params = spark.createDataFrame([{k: v if isinstance(v, str) else float(v) for k, v in summary.items()}])
    for name, df in (("partitions", sets), ("models", models), ("parameters", params)):
        (tag(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("outcome", "config").parquet(f"{path}/{name}"))


def load_model_set(spark: SparkSession, path: str, outcome: str | None = None, config: str | None = None) -> dict[str, DataFrame]:
    """The saved tables; the filters prune folders."""
    out = {}
    for name in ("partitions", "models", "parameters"):
        df = spark.read.parquet(f"{path}/{name}")
        if outcome is not None:
            df = df.where(F.col("outcome") == outcome)
        if config is not None:
            df = df.where(F.col("config") == config)
        out[name] = df
    return out


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Settings that have no written result yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def write_sweep(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write the results of a sweep so that repeated settings replace themselves."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
