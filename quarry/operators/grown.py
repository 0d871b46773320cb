"""Profiles of a table that grows by parts, from the stored states of its parts.

``add_part`` (``plans.profilestate``) reads a part once; the functions here answer for all parts from what
was stored and read none of the tables again.  They return what ``profile`` and ``values`` return for the
whole table.  Without any finished part they raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import CATEGORICAL, NUMERIC
from ..functions.exprs import pct
from ..plans.guards import cut_lineage
from ..plans.profilestate import add_part, merged_cells, merged_columns, merged_intervals, merged_outside, merged_quantiles, numeric_keys
from .profile import PROBE_NAMES, PROFILE_PROBS, cardinality, numeric_block
from .values import binned

__all__ = ["add_part", "grown_column_profile", "grown_histogram", "grown_numeric_profile", "grown_top_values"]


def grown_numeric_profile(spark: SparkSession, path: str, k: float = 1.5) -> DataFrame:
    """``numeric_profile`` of all parts; quantiles and outlier counts are exact, moments combined."""
    keys = numeric_keys(spark, path)
    if not keys:
        return spark.createDataFrame([], "col_name string")
    runs = cut_lineage(merged_intervals(spark, path))
    found = {c: v for c, v in merged_quantiles(spark, path, PROFILE_PROBS, runs=runs).items() if v[0] is not None}
    qs = spark.createDataFrame([(keys[c], *v) for c, v in found.items()], "key int, " + ", ".join(f"{n} double" for n in PROBE_NAMES))
    q1, q3 = PROBE_NAMES.index("p25"), PROBE_NAMES.index("p75")
    fences = {c: (v[q1] - k * (v[q3] - v[q1]), v[q3] + k * (v[q3] - v[q1])) for c, v in found.items()}
    n, m2 = F.col("n"), F.col("m2")
    stats = merged_columns(spark, path).where(F.col("col_class") == NUMERIC).withColumns({
        "variance": F.try_divide(m2, n - 1), "skewness": F.try_divide(F.sqrt(n) * F.col("m3"), F.pow(m2, F.lit(1.5))),
        "kurtosis": F.try_divide(n * F.col("m4"), m2 * m2) - 3,
        "zeros_count": F.when(n > 0, F.col("zeros")), "negative_count": F.when(n > 0, F.col("negatives"))})
    outside = merged_outside(spark, path, fences, runs)
    both = stats.withColumn("std", F.sqrt("variance")).join(qs, "key", "left").join(outside, "key", "left")
    return numeric_block(both.withColumn("outliers_count", F.coalesce("outside", F.lit(0))))


def grown_column_profile(spark: SparkSession, path: str) -> DataFrame:
    """``column_profile`` of all parts: the merged cells are counted, so distinct values are exact."""
    filled = F.col("v").isNotNull() | F.col("cell").isNotNull()
    distinct = merged_cells(spark, path).where(filled).groupBy("key").agg(F.count("*").alias("distinct"))
    rows = merged_columns(spark, path).join(distinct, "key", "left").withColumn("unique_count", F.coalesce("distinct", F.lit(0)))
    return rows.select(
        "col_name", "dtype", "col_class", F.col("missing").alias("missing_count"),
        F.coalesce(pct(F.col("missing"), F.col("rows")), F.lit(0.0)).alias("missing_pct"),
        "unique_count", cardinality(F.col("unique_count")).alias("cardinality"))


def grown_histogram(spark: SparkSession, path: str, cols: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """``histogram`` of all parts; each distinct value is binned once, with its count."""
    keys = numeric_keys(spark, path)
    keys = {c: keys[c] for c in (keys if cols is None else cols) if c in keys}
    if not keys:
        return spark.createDataFrame([], "col_name string, bin int, bin_start double, bin_end double, count long")
    names = spark.createDataFrame([(k, c) for c, k in keys.items()], "key int, col_name string")
    cells = merged_cells(spark, path).where(F.col("key").isin(list(keys.values())))
    return binned(cells.join(F.broadcast(names), "key").select("col_name", F.col("v").alias("x"), "c"), ["col_name"], bins, {"col_name": "col_name"}, F.sum("c"))


def grown_top_values(spark: SparkSession, path: str, k: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """``top_values`` of all parts, for categorical columns or the given categorical and numeric ones."""
    known = {r["col_name"]: r for r in merged_columns(spark, path).select("key", "col_name", "dtype", "col_class").collect()}
    cols = [c for c, r in known.items() if r["col_class"] == CATEGORICAL] if cols is None else list(cols)
    if other := [c for c in cols if c not in known or known[c]["col_class"] not in (CATEGORICAL, NUMERIC)]:
        raise ValueError(f"top values are kept of categorical and numeric columns, not of {other}")
    if not cols:
        return spark.createDataFrame([], "col_name string, rank int, value string, count long, pct double")
    names = spark.createDataFrame([(known[c]["key"], c, known[c]["dtype"]) for c in cols], "key int, col_name string, dtype string")
    v, dtype = F.col("v"), F.col("dtype")
    number = F.when(dtype.isin("double", "float"), v.cast("string")).otherwise(v.cast("long").cast("string"))
    cells = merged_cells(spark, path).join(F.broadcast(names), "key").select("col_name", F.coalesce("cell", number).alias("value"), "c").where("value IS NOT NULL")
    totals = F.broadcast(cells.groupBy("col_name").agg(F.sum("c").alias("total")))  # a row a column
    order = Window.partitionBy("col_name").orderBy(F.col("c").desc(), "value")
    top = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(totals, "col_name")
    return top.select("col_name", F.col("rank").cast("int").alias("rank"), "value", F.col("c").alias("count"), pct(F.col("c"), F.col("total")).alias("pct"))
