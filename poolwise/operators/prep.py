"""Preparation of raw tables: recodes, bins, fills, joins and scalings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolwise.functions.groups import attach
from poolwise.functions.running import running
from poolwise.runtime import materialize


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Keep and rename: ``{old: new}``."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast some columns and keep the rest."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def union_cohorts(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables by column name; columns of one cohort only become null."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def first_present(*columns: str | Column) -> Column:
    """First non-null value."""
    return F.coalesce(*[_col(c) for c in columns])


def recode(column: str | Column, mapping: Mapping, default=None, null_label=None) -> Column:
    """Value to label (P4): values not listed get ``default``, nulls get ``null_label``."""
    c = _col(column)
    out = F.when(c.isNull(), F.lit(null_label))
    for value, label in mapping.items():
        out = out.when(c == F.lit(value), F.lit(label))
    return out.otherwise(F.lit(default))


def recode_by_table(df: DataFrame, column: str, table: DataFrame, value: str, label: str, out: str) -> DataFrame:
    """The same with a mapping table instead of literals."""
    side = table.select(F.col(value).alias(column), F.col(label).alias(out))
    return df.join(side, column, "left")


def band(column: str | Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bands over ascending edges; one label more than edges."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    c = _col(column)
    out = F.when(c.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        out = out.when(c <= F.lit(edge), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def group_levels(column: str | Column, groups: Mapping[int, Sequence[int]]) -> Column:
    """Integer values to levels: ``{level: values}``."""
    c, out = _col(column), None
    for level, values in groups.items():
        cond = c.isin(*values)
        out = F.when(cond, level) if out is None else out.when(cond, level)
    return out


def cap(column: str | Column, top: int) -> Column:
    """Values above ``top`` count as ``top`` (P6); null stays null."""
    c = _col(column)
    return F.when(c.isNotNull(), F.least(c, F.lit(top)))


def quantile_edges(df: DataFrame, column: str, parts: int, by: list[str] = (), exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Outer and inner quantile edges of a column as the array ``edges``.

    The exact form interpolates linearly between the two neighbouring ranks.
    It counts each distinct value once, ranks the counts by ranges and picks
    the few values needed, so no task holds the column.  The approximate form
    is a mergeable sketch of bounded size.
    """
    by = list(by)
    present = df.where(F.col(column).isNotNull())
    if not exact:
        probs = [k / parts for k in range(parts + 1)]
        return present.groupBy(*by).agg(F.percentile_approx(column, probs, accuracy).alias("edges"))
    return quantiles(present, column, [k / parts for k in range(parts + 1)], by).withColumnRenamed("quantiles", "edges")


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: list[str] = ()) -> DataFrame:
    """Exact quantiles at ``shares`` of 0 to 1, as the array ``quantiles``, of each group or of the whole column.

    Linear between the two neighbouring ranks, nulls left out.  Each distinct value is counted once, the counts are
    ranked by ranges, and the few values needed are picked by aggregation, so no task holds a group.
    """
    by = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = materialize(running(counts, by, ["_v"], sums={"_upto": "_c"}, position=None), "ranked")
    totals = ranked.groupBy(*by).agg(F.max("_upto").alias("_n"))
    if by:
        same = [F.col(f"r.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by]
        ranked = ranked.alias("r").join(totals.alias("t"), same).select(*[F.col(f"r.{b}").alias(b) for b in by], "_v", "_upto", "_n")
    else:
        ranked = ranked.withColumn("_n", totals.scalar())
    picks = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("_n") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v")))
        high = F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v")))
        picks.append(low + F.max(place - F.floor(place)) * (high - low))
    return ranked.groupBy(*by).agg(F.array(*picks).alias("quantiles"))


def quantile_cut(df: DataFrame, column: str, parts: int, out: str, exact: bool = True) -> DataFrame:
    """Level 0..parts-1 by quantile (P7): right-closed, the lowest value included, nulls stay null.

    Equal edges are dropped, and the levels that remain are numbered without
    gaps.
    """
    edges = quantile_edges(df, column, parts, exact=exact).scalar()
    df = df.withColumn("_e", F.array_distinct(edges))
    level = F.aggregate(F.slice(F.col("_e"), 2, F.greatest(F.size("_e") - 2, F.lit(0))), F.lit(0),
                        lambda acc, e: acc + F.when(F.col(column) > e, 1).otherwise(0))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), level)).drop("_e")


def row_max(*columns: str | Column) -> Column:
    """Row-wise largest value, nulls skipped."""
    return F.greatest(*[_col(c) for c in columns])


def row_mean(*columns: str | Column) -> Column:
    """Row-wise mean, nulls skipped; null if all are."""
    cols = [_col(c).cast("double") for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols[1:]), F.when(cols[0].isNotNull(), 1).otherwise(0))
    return F.when(present > 0, total / present)


def fill_defaults(df: DataFrame, defaults: Mapping) -> DataFrame:
    """Default per column instead of null (P10)."""
    return df.fillna(dict(defaults))


def left_join(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left equi-join; columns both sides have get a suffix."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    l = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    r = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return l.join(r, on, "left")


def complete_cases(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows without nulls in the given columns, or in any."""
    return df.na.drop(subset=subset)


def without_outliers(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows inside the limits, and rows without a value (P13); unwanted single rows go by key with ``without_keys``."""
    cond = F.lit(True)
    if low is not None:
        cond = cond & (F.col(column) >= low)
    if high is not None:
        cond = cond & (F.col(column) <= high)
    return df.where(F.coalesce(cond, F.lit(True)))


def without_keys(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Drop single rows by key (P13); a row without a key stays."""
    return df.where(F.coalesce(~F.col(key).isin(*values), F.lit(True)))


def min_max_scale(df: DataFrame, column: str, out: str, by: list[str] = ()) -> DataFrame:
    """(y - min) / (max - min) over the table or per group (P14); null where all values are equal."""
    df = attach(df, by, _lo=F.min(column), _hi=F.max(column))
    return df.withColumn(out, F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def shift_levels(df: DataFrame, spec, factors: list[str]):
    """Raise the levels of some factors by one, so none of their rows is inactive.

    Returns the table and the design with one level more for these factors.
    """
    from poolwise.spec import FactorSpec
    levels = [r + 1 if n in factors else r for n, r in zip(spec.names, spec.levels)]
    return df.withColumns({f: F.col(f) + 1 for f in factors}), FactorSpec(spec.names, levels)


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows that meet each conjunction, in one pass."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def melt_outcomes(df: DataFrame, keys: list[str], outcomes: list[str], name: str = "outcome", value: str = "y") -> DataFrame:
    """One row per (row, outcome): what lets one job serve many outcomes."""
    return df.unpivot(keys, outcomes, name, value).where(F.col(value).isNotNull())
