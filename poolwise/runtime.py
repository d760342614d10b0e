"""Session-level helpers: shared scratch space, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is only hinted for broadcast when the design proves it has at most this many rows.
BROADCAST_ROWS = 4_000_000
# Rows that one task should unfold, and most tasks that a spread asks for.
ROWS_PER_TASK, MOST_TASKS = 2_000_000, 20_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for local sessions."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="poolwise-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    Unlike a cached table it survives lost executors, and the plan above it
    starts again from a plain scan with known size.  The table belongs to the
    session's application: ``discard`` removes it, ``clear`` all that are left.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more; other tables are left alone."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            _remove(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all written tables of this application, results that were not saved elsewhere included."""
    _remove(spark, _own_dir(spark))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/poolwise/{spark.sparkContext.applicationId}"


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash rows over all tasks by key, ahead of an expansion.

    Tables of design size often sit in one small file or one coalesced
    partition, while a row of theirs can unfold into thousands.  The work is in
    the unfolding, so the number of tasks follows the ``rows`` that the design
    says will come of it, whatever executors are there at the moment, and is no
    less than twice their cores.  It is stated, so adaptive execution does not merge
    the partitions again.  A grouping on these keys (and more) afterwards needs no
    further shuffle.
    """
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(rows // ROWS_PER_TASK, MOST_TASKS)), *keys)


def bounded(df: DataFrame, rows: int, by: list[str] = ()) -> DataFrame:
    """Broadcast hint for a table of at most ``rows`` rows, when that is small enough.

    Beyond the bound the table is returned as it is and the join shuffles.  A
    table that is also keyed by ``by`` has an unknown number of such parts, so
    it gets no hint.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS and not by else df


def scalar(df: DataFrame):
    """The single value of a one-row, one-column aggregate."""
    return df.first()[0]
