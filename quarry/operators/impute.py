"""Imputation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import column_class, is_float, numeric_columns, q
from ..plans import ordered
from ..plans.fitted import Fitted, Request, planned, step


def _split(df: DataFrame, cols):
    num = numeric_columns(df, cols)
    return num, [c for c in cols if c not in num]


def _fill_literals(df: DataFrame, fills: dict) -> DataFrame:
    out = {}
    for c, v in fills.items():
        if v is None:
            continue
        dt = df.schema[c].dataType
        col = q(c) if is_float(dt) or isinstance(dt, T.DecimalType) else q(c).cast("double")
        out[c] = F.coalesce(col, F.lit(float(v)))
    return df.withColumns(out) if out else df


@planned("fillna_mean")
def fit_fillna_mean(df: DataFrame, cols, **_):
    num, skipped = _split(df, cols)

    def build(values, _):
        means = {c: values[f"m{i}"] for i, c in enumerate(num)}
        return Fitted("fillna_mean", num, lambda d: _fill_literals(d, means), skipped, values=means)

    return Request(num, build, {f"m{i}": F.avg(q(c)) for i, c in enumerate(num)})


@planned("fillna_median")
def fit_fillna_median(df: DataFrame, cols, quantile_method: str = "exact", **_):
    num, skipped = _split(df, cols)

    def build(_, quantiles):
        medians = {c: quantiles[c][0] for c in num}
        return Fitted("fillna_median", num, lambda d: _fill_literals(d, medians), skipped, values=medians)

    return Request(num, build, quantiles={c: [0.5] for c in num}, method=quantile_method)


def _mode_values(df: DataFrame, cols) -> dict:
    """Smallest most frequent non-NULL value per column, one job for all columns.

    Values are counted as (col, label) pairs with a typed sort key (number or
    text), and the winner per column comes from ``row_number() <= 1`` (a partial
    WindowGroupLimit), so no column's distinct values meet in one task."""
    structs = []
    for c in cols:
        dt = df.schema[c].dataType
        numeric = column_class(dt) == "numeric"
        structs.append(F.struct(
            F.lit(c).alias("col_name"),
            q(c).cast("string").alias("label"),
            (q(c).cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
        ))
    vc = (df.select(F.inline(F.array(*structs))).where(F.col("label").isNotNull())
          .groupBy("col_name", "label", "num").count())
    w = Window.partitionBy("col_name").orderBy(F.col("count").desc(), F.col("num").asc_nulls_last(), F.col("label"))
    top = vc.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 1)  # planned as a partial WindowGroupLimit
    return {r["col_name"]: r["label"] for r in top.collect()}  # one row per column


@step("fillna_mode")
def fit_fillna_mode(df: DataFrame, cols, unknown: str = "Unknown", **_):
    cols = [c for c in cols if c in df.columns]
    modes = _mode_values(df, cols) if cols else {}

    def apply(d: DataFrame) -> DataFrame:
        out = {}
        for c in cols:
            dt = d.schema[c].dataType
            if c in modes:
                out[c] = F.coalesce(q(c), F.lit(modes[c]).cast(dt))
            elif isinstance(dt, T.StringType):
                out[c] = F.coalesce(q(c), F.lit(unknown))
            else:  # all NULL: the reference fills the text "Unknown", which makes the column text
                out[c] = F.coalesce(q(c).cast("string"), F.lit(unknown))
        return d.withColumns(out) if out else d

    return Fitted("fillna_mode", cols, apply, values=modes)


@step("fillna_ffill")
def fit_fillna_ffill(df: DataFrame, cols, order_by=None, partition_by=(), **kw):
    cols = [c for c in cols if c in df.columns]
    if not order_by:
        raise ValueError("fillna_ffill needs order_by (Spark rows have no implicit order)")
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    return Fitted("fillna_ffill", cols, lambda d: ordered.forward_fill(d, cols, order_by, partition_by, **kw)
                  if cols else d, stateless=False)


@step("fillna_bfill")
def fit_fillna_bfill(df: DataFrame, cols, order_by=None, partition_by=(), **kw):
    cols = [c for c in cols if c in df.columns]
    if not order_by:
        raise ValueError("fillna_bfill needs order_by (Spark rows have no implicit order)")
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    return Fitted("fillna_bfill", cols, lambda d: ordered.backward_fill(d, cols, order_by, partition_by, **kw)
                  if cols else d, stateless=False)


def fillna_mean(df, cols):
    return fit_fillna_mean(df, cols).apply(df)


def fillna_median(df, cols, **kw):
    return fit_fillna_median(df, cols, **kw).apply(df)


def fillna_mode(df, cols):
    return fit_fillna_mode(df, cols).apply(df)


def fillna_ffill(df, cols, order_by, partition_by=(), **kw):
    return ordered.forward_fill(df, cols, [order_by] if isinstance(order_by, str) else order_by, partition_by, **kw)


def fillna_bfill(df, cols, order_by, partition_by=(), **kw):
    return ordered.backward_fill(df, cols, [order_by] if isinstance(order_by, str) else order_by, partition_by, **kw)
