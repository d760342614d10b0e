"""Attach aggregates of a table, or of each of its groups, to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def attach(df: DataFrame, by: list[str] = (), **aggs: Column) -> DataFrame:
    """Add ``name=aggregate`` columns without a window.

    Whole-table values come from scalar subqueries; per-group values are
    partially aggregated and joined by key, so a heavy group is never sorted
    in one task.
    """
    by = list(by)
    if not by:
        return df.withColumns({k: df.agg(a).scalar() for k, a in aggs.items()})
    return df.join(df.groupBy(*by).agg(*[a.alias(k) for k, a in aggs.items()]), by)
