"""Projection, row filters, deduplication and derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC, classes, is_float, q
from ..plans.fingerprints import fingerprint, parted, worth_it
from ..plans.fitted import Fitted, step


def project_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the requested columns that exist, in request order."""
    return df.select(*[q(c) for c in cols if c in df.columns])


def select_features(df: DataFrame, features: Sequence[str], target: str, time: str | None = None) -> DataFrame:
    """Features minus the target, then the target, then the time column when it is not already kept."""
    feats = [c for c in features if c != target]
    keep = feats + [target]
    if time and time not in keep:
        keep.append(time)
    return df.select(*[q(c) for c in keep])


def select_numeric(df: DataFrame) -> DataFrame:
    kinds = classes(df)
    return df.select(*[q(c) for c in df.columns if kinds[c] == NUMERIC])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def derive(df: DataFrame, name: str, expr: str) -> DataFrame:
    """New or replaced column from a Spark SQL expression (never executed as code); NaN counts as missing."""
    out = df.withColumn(name, F.expr(expr))
    return out.withColumn(name, F.when(~F.isnan(q(name)), q(name))) if is_float(out.schema[name].dataType) else out


def dropna_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any column (or in ``subset``)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def drop_duplicates_all(df: DataFrame, mark=fingerprint) -> DataFrame:
    """Drop exact duplicate rows (NULLs compare equal).

    Wide rows are found by counted fingerprints; only those that repeat are shuffled (``plans.fingerprints``)."""
    if not worth_it(df):
        return df.dropDuplicates()
    once, several = parted(df, df.columns, mark)
    return once.unionByName(several.dropDuplicates())


def drop_duplicates_subset(df: DataFrame, cols: Sequence[str], order_by: Sequence[str] | None = None, mark=fingerprint) -> DataFrame:
    """Keep the first row (by ``order_by``) of each ``cols`` key; no-op without columns.

    Only rows whose key repeats are shuffled (by counted fingerprints, where rows are wide).  Of those
    ``min_by(struct(row), struct(order))`` is a partial aggregate: a key holding a third of all rows is
    reduced map-side, not windowed in one task."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if not order_by:
        if not worth_it(df):
            return df.dropDuplicates(cols)
        once, several = parted(df, cols, mark)
        return once.unionByName(several.dropDuplicates(cols))
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)

    def first_of_each(rows: DataFrame) -> DataFrame:
        row = F.struct(*[q(c) for c in df.columns])
        key = F.struct(*[q(c) for c in order_by])
        first = rows.groupBy(*[q(c).alias(f"k{i}") for i, c in enumerate(cols)]).agg(F.min_by(row, key).alias("first"))
        return first.select(*[F.col("first")[c].alias(c) for c in df.columns])

    if not worth_it(df):
        return first_of_each(df)
    once, several = parted(df, cols, mark)
    return once.unionByName(first_of_each(several))


@step("dropna_rows")
def fit_dropna_rows(df, cols, subset=None, **_):
    return Fitted("dropna_rows", list(df.columns), lambda d: dropna_rows(d, subset))


@step("drop_duplicates_all")
def fit_drop_duplicates_all(df, cols, **_):
    return Fitted("drop_duplicates_all", list(df.columns), lambda d: drop_duplicates_all(d), stateless=False)


@step("drop_duplicates_subset")
def fit_drop_duplicates_subset(df, cols, order_by=None, **_):
    return Fitted("drop_duplicates_subset", list(cols), lambda d: drop_duplicates_subset(d, cols, order_by),
                  stateless=False)


@step("drop_columns")
def fit_drop_columns(df, cols, **_):
    return Fitted("drop_columns", list(cols), lambda d: drop_columns(d, cols))


@step("derive")
def fit_derive(df, cols, name=None, expr=None, **_):
    if not name or not expr:
        raise ValueError("derive needs name and expr")
    return Fitted("derive", [name], lambda d: derive(d, name, expr))
