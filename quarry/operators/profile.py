"""Dataset- and column-level profiling.

Every statistic is a fused aggregate over the whole table: one scalar pass for
all columns, one pass of bitmap words for distinct counts (``plans.distinct``), one pass for
quantiles (``plans.quantiles``) and one for bounds that depend on them.  Results
are long tables (one row per column) rather than nested documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    classes,
    column_class,
    dtype_name,
    is_float,
    numeric_columns,
    q,
)
from ..functions.exprs import pct, rnd, safe_div
from ..plans.crossproducts import cross_products, pearson
from ..plans.distinct import distinct_counts
from ..plans.fingerprints import fingerprint, parted, worth_it
from ..plans.guards import fused_agg
from ..plans.quantiles import column_quantiles, long_format

PROFILE_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
PROBE_NAMES = ("p1", "p5", "p25", "p50", "p75", "p95", "p99")


def duplicate_rows(df: DataFrame, mark=fingerprint) -> DataFrame:
    """Rows beyond the first of each identical group (NULLs compare equal), and %.

    Grouped with partial aggregation, so a hot duplicate group is combined map-side.  Of wide rows only
    those whose fingerprint repeats are grouped in full (``plans.fingerprints``)."""
    several = parted(df, df.columns, mark)[1] if worth_it(df) else df
    groups = several.groupBy(*[q(c) for c in df.columns]).count()
    found = groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    return found.withColumn("total_rows", F.lit(df.count())).select(
        "duplicate_rows",
        F.coalesce(pct(F.col("duplicate_rows"), F.col("total_rows")), F.lit(0.0)).alias("duplicate_rows_pct"),
    )


def row_missingness(df: DataFrame) -> DataFrame:
    """Rows with more than 50 % / 80 % of their cells missing; columns more than 50 % missing."""
    ncols = len(df.columns)
    nulls = sum((q(c).isNull().cast("int") for c in df.columns), F.lit(0))
    share = nulls / F.lit(float(ncols))
    col_share = [F.avg(q(c).isNull().cast("double")) for c in df.columns]
    return df.agg(
        F.sum((share > 0.5).cast("long")).alias("rows_50pct_missing"),
        F.sum((share > 0.8).cast("long")).alias("rows_80pct_missing"),
        sum(((s > 0.5).cast("long") for s in col_share), F.lit(0)).cast("long").alias("cols_50pct_missing"),
    ).select(
        F.coalesce("rows_50pct_missing", F.lit(0)).cast("long").alias("rows_50pct_missing"),
        F.coalesce("rows_80pct_missing", F.lit(0)).cast("long").alias("rows_80pct_missing"),
        F.coalesce("cols_50pct_missing", F.lit(0)).cast("long").alias("cols_50pct_missing"),
    )


def dataset_overview(df: DataFrame, with_duplicates: bool = True, distinct: str = "exact") -> DataFrame:
    """One row: shape, missing cells, quality score, class counts, constant columns, duplicates.

    Three bounded one-row aggregates (scalar pass, distinct pass, duplicate pass)
    are combined on the driver into the one-row result.
    """
    spark = df.sparkSession
    kinds = classes(df)
    ncols = len(df.columns)
    n_num = sum(1 for k in kinds.values() if k == NUMERIC)
    n_cat = sum(1 for k in kinds.values() if k == CATEGORICAL)
    n_dt = sum(1 for k in kinds.values() if k == DATETIME)
    miss = [F.sum(q(c).isNull().cast("long")) for c in df.columns]
    st = df.agg(
        F.count(F.lit(1)).alias("rows"),
        sum(miss, F.lit(0)).cast("long").alias("total_missing_cells"),
        sum(((m > F.count(F.lit(1)) * 0.5).cast("long") for m in miss), F.lit(0)).cast("long").alias("high_missing_cols"),
    ).first()
    const = column_unique_counts(df, distinct=distinct).agg(F.sum((F.col("unique_count") == 1).cast("long"))).first()[0] or 0
    rows, missing = st["rows"], st["total_missing_cells"] or 0
    cells = rows * ncols
    share = missing / cells if cells else 0.0
    rec = {
        "rows": rows, "columns": ncols, "total_missing_cells": missing,
        "missing_pct": round(share * 100, 6), "quality_score": round((1 - share) * 100, 1),
        "high_missing_cols": st["high_missing_cols"] or 0,
        "numeric_count": n_num, "categorical_count": n_cat, "datetime_count": n_dt,
        "numeric_pct": round(n_num / ncols * 100, 1) if ncols else 0.0,
        "categorical_pct": round(n_cat / ncols * 100, 1) if ncols else 0.0,
        "datetime_pct": round(n_dt / ncols * 100, 1) if ncols else 0.0,
        "constant_columns": const,
    }
    schema = ("rows long, columns long, total_missing_cells long, missing_pct double, quality_score double, "
              "high_missing_cols long, numeric_count long, categorical_count long, datetime_count long, "
              "numeric_pct double, categorical_pct double, datetime_pct double, constant_columns long")
    if with_duplicates:
        d = duplicate_rows(df).first()
        rec["duplicate_rows"], rec["duplicate_rows_pct"] = d["duplicate_rows"], d["duplicate_rows_pct"]
        schema += ", duplicate_rows long, duplicate_rows_pct double"
    return spark.createDataFrame([rec], schema)


def column_unique_counts(df: DataFrame, cols: Sequence[str] | None = None, distinct: str = "exact") -> DataFrame:
    """(col_name, unique_count): distinct non-NULL values per column, by bitmaps and hashes (``plans.distinct``).

    ``distinct="approx"``: sketches (relative error about 5 %, small counts exact as a rule)."""
    if distinct == "approx":
        names = list(df.columns if cols is None else cols)
        r = fused_agg(df, [F.approx_count_distinct(q(c)).alias(f"u{i}") for i, c in enumerate(names)])
        return df.sparkSession.createDataFrame([(c, r[f"u{i}"]) for i, c in enumerate(names)], "col_name string, unique_count long")
    found = distinct_counts(df, list(df.columns if cols is None else cols))
    return df.sparkSession.createDataFrame(list(found.items()), "col_name string, unique_count long")


def column_profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """Per column: dtype, class, missing count/%, distinct (NULLs excluded), cardinality level.

    ``distinct="approx"`` counts distinct values by sketches in one scan, without a shuffle of cells."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, dtype_name(f.dataType), column_class(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "col_idx int, col_name string, dtype string, col_class string",
    )
    miss = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(q(c).isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    missing = miss.select(
        "rows",
        F.inline(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(f"m{i}").alias("missing_count"))
                           for i, c in enumerate(df.columns)])),
    )
    uniq = column_unique_counts(df, distinct=distinct)
    out = meta.join(missing, "col_name").join(uniq, "col_name", "left")
    u = F.coalesce(F.col("unique_count"), F.lit(0)).cast("long")
    return out.select(
        "col_name", "dtype", "col_class",
        F.coalesce(F.col("missing_count"), F.lit(0)).cast("long").alias("missing_count"),
        F.coalesce(pct(F.col("missing_count"), F.col("rows")), F.lit(0.0)).alias("missing_pct"),
        u.alias("unique_count"),
        cardinality(u).alias("cardinality"),
    )


def cardinality(unique: Column) -> Column:
    """Level of a count of distinct values."""
    return F.when(unique < 10, "Low").when(unique < 50, "Medium").otherwise("High")


def _scalar_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments, zeros and negatives, one row per numeric column: one grouped pass over (column, value)."""
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "col_name string")
    x = F.col("v")
    stats = long_format(df, cols, key="col_name").groupBy("col_name").agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
        F.count_if(x == 0).alias("zeros_count"), F.count_if(x < 0).alias("negative_count"))
    return names.join(stats, "col_name", "left").fillna(0, ["n"])


def _quantile_wide(df: DataFrame, cols: Sequence[str], probs, names, method: str) -> DataFrame:
    """``col_name`` and one column a quantile, for columns with values (the numbers are collected: columns x probs)."""
    found = column_quantiles(df, cols, probs, method)
    rows = [(c, *v) for c, v in found.items() if v[0] is not None]
    return df.sparkSession.createDataFrame(rows, "col_name string, " + ", ".join(f"{n} double" for n in names))


def numeric_summary(df: DataFrame, quantile_method: str = "exact") -> DataFrame:
    """Basic profile block: min, max, mean, median, std, q25, q75 per numeric column."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string")
    sc = _scalar_numeric(df, cols)
    qs = _quantile_wide(df, cols, (0.25, 0.5, 0.75), ("q25", "median", "q75"), quantile_method)
    out = sc.join(qs, "col_name", "left")
    return out.select(
        "col_name", rnd(F.col("min")).alias("min"), rnd(F.col("max")).alias("max"), rnd(F.col("mean")).alias("mean"),
        rnd(F.col("median")).alias("median"), rnd(F.col("std")).alias("std"),
        rnd(F.col("q25")).alias("q25"), rnd(F.col("q75")).alias("q75"),
    )


def numeric_profile(df: DataFrame, quantile_method: str = "exact", k: float = 1.5) -> DataFrame:
    """Full numeric block per column (non-NULL values): moments, percentiles, IQR, cv, zeros,
    negatives, skewness, excess kurtosis and IQR outlier counts."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string")
    sc = _scalar_numeric(df, cols)
    qs = _quantile_wide(df, cols, PROFILE_PROBS, PROBE_NAMES, quantile_method)
    base = sc.join(qs, "col_name", "left")
    outl = iqr_outlier_counts(df, k, quantile_method, quartiles=qs.select("col_name", "p25", "p75"))
    return numeric_block(base.join(outl.select("col_name", "outliers_count"), "col_name", "left"))


def numeric_block(stats: DataFrame) -> DataFrame:
    """The columns of ``numeric_profile`` from counts, moments, quantiles and outlier counts per column."""
    n = F.col("n")
    return stats.select(
        "col_name",
        n.cast("long").alias("count"),
        *[rnd(F.col(c)).alias(c) for c in ("min", "max", "mean")],
        rnd(F.col("p50")).alias("median"),
        rnd(F.col("std")).alias("std"),
        rnd(F.col("variance")).alias("variance"),
        *[rnd(F.col(c)).alias(c) for c in PROBE_NAMES],
        rnd(F.col("p75") - F.col("p25")).alias("iqr"),
        rnd(F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0))).alias("cv"),
        F.col("zeros_count").cast("long").alias("zeros_count"),
        pct(F.col("zeros_count"), n).alias("zeros_pct"),
        F.col("negative_count").cast("long").alias("negative_count"),
        pct(F.col("negative_count"), n).alias("negative_pct"),
        rnd(F.col("skewness")).alias("skewness"),
        rnd(F.col("kurtosis")).alias("kurtosis"),
        F.col("outliers_count").cast("long").alias("outliers_count"),
        pct(F.col("outliers_count"), n).alias("outliers_pct"),
    )


def shape_moments(df: DataFrame) -> DataFrame:
    """Biased skewness and excess kurtosis per numeric column (scipy defaults)."""
    cols = numeric_columns(df)
    sc = _scalar_numeric(df, cols)
    return sc.select("col_name", rnd(F.col("skewness")).alias("skewness"), rnd(F.col("kurtosis")).alias("kurtosis"))


def iqr_outlier_counts(df: DataFrame, k: float = 1.5, quantile_method: str = "exact", quartiles=None) -> DataFrame:
    """Count/% of non-NULL values outside [Q1 - k IQR, Q3 + k IQR] per numeric column.

    The fitted bounds (one row per column) are collected and embedded as literals,
    so the counting pass is a single fused aggregate over the table.
    """
    cols = numeric_columns(df)
    if quartiles is None:
        quartiles = _quantile_wide(df, cols, (0.25, 0.75), ("p25", "p75"), quantile_method)
    bounds = {r["col_name"]: (r["p25"], r["p75"]) for r in quartiles.collect()}
    aggs = []
    for i, c in enumerate(cols):
        q1, q3 = bounds.get(c, (None, None))
        x = q(c).cast("double")
        aggs.append(F.count(x).alias(f"n{i}"))
        if q1 is None:
            aggs.append(F.lit(0).alias(f"o{i}"))
            continue
        iqr = q3 - q1
        aggs.append(F.sum(((x < q1 - k * iqr) | (x > q3 + k * iqr)).cast("long")).alias(f"o{i}"))
    r = fused_agg(df, aggs)
    rows = [(c, int(r[f"o{i}"] or 0), r[f"n{i}"]) for i, c in enumerate(cols)]
    out = df.sparkSession.createDataFrame(rows, "col_name string, outliers_count long, n long")
    return out.select("col_name", "outliers_count", pct(F.col("outliers_count"), F.col("n")).alias("outliers_pct"))


def zero_heavy_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Numeric columns whose share of zeros (denominator: all rows) exceeds ``threshold``."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string, zero_share double")
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum((q(c) == 0).cast("long")).alias(f"z{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("col_name"), F.coalesce(F.col(f"z{i}"), F.lit(0)).alias("zeros")) for i, c in enumerate(cols)]
    long = row.select("rows", F.inline(F.array(*structs)))
    share = safe_div(F.col("zeros"), F.col("rows"))
    return long.where(share > threshold).select("col_name", rnd(share).alias("zero_share"))


def table_bytes(df: DataFrame) -> DataFrame:
    """Approximate bytes per column: string/binary payload lengths, fixed width otherwise.

    (The reference reports pandas heap bytes; values differ by nature.)"""
    widths = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
              T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = q(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            aggs.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long").alias(f"b{i}"))
        elif type(f.dataType) in widths:
            aggs.append((F.count(F.lit(1)) * widths[type(f.dataType)]).cast("long").alias(f"b{i}"))
        else:
            aggs.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(c)))), F.lit(0)).cast("long").alias(f"b{i}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(f.name).alias("col_name"), F.col(f"b{i}").alias("bytes")) for i, f in enumerate(df.schema.fields)]
    return row.select(F.inline(F.array(*structs)))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson r for every ordered pair (pairwise-complete), rounded to 3; diagonal 1.0 when defined.

    Rows with a NULL or NaN on either side are skipped, like pandas.  All pairs come from two scans (means,
    then ``plans.crossproducts``); the result stays a table and is mirrored there."""
    cols = numeric_columns(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, correlation double")
    upper = pearson(cross_products(df, cols))
    pairs = df.sparkSession.range(len(cols)).select(
        F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(len(cols) - 1))).alias("j"))
    both = pairs.join(upper, ["i", "j"], "left").select(F.round("r", 3).alias("correlation"), F.explode(
        F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("at"))
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.get(names, F.col("at.i")).alias("col1"), F.get(names, F.col("at.j")).alias("col2"), "correlation")


def high_corr_pairs(df: DataFrame, threshold: float = 0.8, top: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairs i<j (column order) with |r| > threshold, strongest first, at most ``top``."""
    cols = numeric_columns(df, cols)
    order = {c: i for i, c in enumerate(cols)}
    m = correlation_matrix(df, cols)
    idx = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    m = m.where(idx[F.col("col1")] < idx[F.col("col2")]).where(F.abs("correlation") > threshold)
    return m.orderBy(F.abs("correlation").desc(), idx[F.col("col1")], idx[F.col("col2")]).limit(top)
