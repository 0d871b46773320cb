"""Datetime profile: range, gap frequency, busiest / quietest day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import datetime_columns, q
from ..functions.exprs import ts_text
from ..plans.ordered import sorted_gaps


def _secs(c):
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def datetime_range(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """min, max and elapsed whole days per datetime column (one fused aggregate)."""
    cols = datetime_columns(df) if cols is None else list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string, min_date string, max_date string, range_days long")
    row = df.agg(*[F.min(q(c)).alias(f"a{i}") for i, c in enumerate(cols)], *[F.max(q(c)).alias(f"b{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("col_name"), F.col(f"a{i}").cast("timestamp").alias("mn"),
                        F.col(f"b{i}").cast("timestamp").alias("mx")) for i, c in enumerate(cols)]
    long = row.select(F.inline(F.array(*structs)))
    return long.where(F.col("mn").isNotNull()).select(
        "col_name", ts_text(F.col("mn")).alias("min_date"), ts_text(F.col("mx")).alias("max_date"),
        F.floor((_secs(F.col("mx")) - _secs(F.col("mn"))) / 86400.0).cast("long").alias("range_days"),
    )


def datetime_frequency(df: DataFrame, col: str, **kw) -> DataFrame:
    """Most common gap (whole days) between consecutive sorted values, its label and the mean gap.

    Works on the *distinct* values (a hot timestamp collapses to one row); the
    n - distinct repeated values contribute gaps of 0 days.  The sorted lag uses
    the bucketed ordered plan, never a single-task window."""
    x = q(col)
    counts = df.where(x.isNotNull()).groupBy(x.alias("_t")).count()
    tot = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("d")).first()
    n, d = tot["n"] or 0, tot["d"] or 0
    spark = df.sparkSession
    schema = "col_name string, frequency string, mode_gap_days long, avg_gap_days double"
    if n < 2:
        return spark.createDataFrame([], schema)
    gaps = sorted_gaps(counts.select("_t"), "_t", n=d, **kw).where(F.col("_prev").isNotNull())
    days = F.floor((_secs(F.col("_t")) - _secs(F.col("_prev"))) / 86400.0).cast("long")
    hist = gaps.groupBy(days.alias("gap")).count()
    dup_zeros = n - d
    if dup_zeros:
        hist = hist.unionByName(spark.createDataFrame([(0, dup_zeros)], "gap long, count long")).groupBy("gap").agg(
            F.sum("count").alias("count"))
    stats = hist.agg(
        F.min_by("gap", F.struct(-F.col("count"), F.col("gap"))).alias("mode_gap"),  # most frequent, smallest on ties
        (F.sum(F.col("gap") * F.col("count")) / F.lit(float(n - 1))).alias("mean_gap"),
    )
    m = F.col("mode_gap")
    label = (F.when(m == 1, "Daily").when((m >= 6) & (m <= 8), "Weekly").when((m >= 28) & (m <= 31), "Monthly")
             .otherwise(F.concat(m.cast("string"), F.lit(" days"))))
    return stats.select(F.lit(col).alias("col_name"), label.alias("frequency"), m.cast("long").alias("mode_gap_days"),
                        F.round("mean_gap", 2).alias("avg_gap_days"))


def datetime_activity(df: DataFrame, col: str) -> DataFrame:
    """Busiest and quietest calendar date with counts (ties: earliest date)."""
    per_day = df.where(q(col).isNotNull()).groupBy(F.to_date(q(col)).alias("day")).count()
    ord_day = F.datediff(F.col("day"), F.lit("1970-01-01"))
    agg = per_day.agg(
        F.max_by("day", F.struct(F.col("count"), -ord_day)).alias("peak_date"), F.max("count").alias("peak_count"),
        F.min_by("day", F.struct(F.col("count"), ord_day)).alias("low_date"), F.min("count").alias("low_count"),
    )
    return agg.where(F.col("peak_date").isNotNull()).select(
        F.lit(col).alias("col_name"), F.col("peak_date").cast("string").alias("peak_date"),
        F.col("peak_count").cast("long").alias("peak_count"), F.col("low_date").cast("string").alias("low_date"),
        F.col("low_count").cast("long").alias("low_count"))
