"""Value-count based operators: distinct values, top values, categorical profile, histograms.

All columns are counted in one exploded aggregation: ``inline(array(struct(name,
cast(value as string))))`` then ``groupBy(col_name, value).count()``.  Partial
aggregation combines hot values map-side, so a value holding a third of all rows
costs nothing extra.  Top-k uses ``row_number() <= k`` which Catalyst plans as a
partial ``WindowGroupLimit`` before the shuffle: each column's window only sees
k rows per upstream partition, never all its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, free_name, is_float, numeric_columns, q
from ..functions.exprs import pct, rnd
from ..plans.guards import bounded_broadcast, cut_lineage


def _label(df: DataFrame, name: str):
    c = q(name)
    dt = df.schema[name].dataType
    if is_float(dt):
        c = c + F.lit(0.0)  # -0.0 and 0.0 are one value
    return c.cast("string")


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_name, value, count) for every column, NULL kept as its own row (value NULL)."""
    cols = list(df.columns if cols is None else cols)
    structs = [F.struct(F.lit(c).alias("col_name"), _label(df, c).alias("value")) for c in cols]
    return df.select(F.inline(F.array(*structs))).groupBy("col_name", "value").count()


def top_values(df: DataFrame, k: int = 5, cols: Sequence[str] | None = None, label_chars: int | None = None) -> DataFrame:
    """Most frequent non-NULL values per categorical column: rank, value (cut to ``label_chars`` if given), count, %.

    Ties are broken by the value (code-point order)."""
    cols = categorical_columns(df) if cols is None else list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string, rank int, value string, count long, pct double")
    vc = value_counts(df, cols).where(F.col("value").isNotNull())
    totals = F.broadcast(vc.groupBy("col_name").agg(F.sum("count").alias("total")))  # one row per column
    w = Window.partitionBy("col_name").orderBy(F.col("count").desc(), F.col("value"))
    top = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(totals, "col_name").select(
        "col_name", F.col("rank").cast("int").alias("rank"), (F.substring("value", 1, label_chars) if label_chars else F.col("value")).alias("value"),
        F.col("count").cast("long").alias("count"), pct(F.col("count"), F.col("total")).alias("pct"),
    )


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per categorical column: categories, rare (< 1 %) count, dominant (> 50 %) flag, imbalance ratio."""
    cols = categorical_columns(df) if cols is None else list(cols)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "col_name string, unique_categories long, rare_count long, dominant_category boolean, imbalance_ratio double")
    vc = value_counts(df, cols).where(F.col("value").isNotNull())
    totals = F.broadcast(vc.groupBy("col_name").agg(F.sum("count").alias("total")))
    agg = vc.join(totals, "col_name").groupBy("col_name").agg(
        F.count(F.lit(1)).alias("unique_categories"),
        F.sum((F.col("count") / F.col("total") < 0.01).cast("long")).alias("rare_count"),
        F.max("count").alias("mx"), F.min("count").alias("mn"), F.first("total").alias("total"),
    )
    return agg.select(
        "col_name", F.col("unique_categories").cast("long").alias("unique_categories"),
        F.col("rare_count").cast("long").alias("rare_count"),
        (F.col("mx") / F.col("total") > 0.5).alias("dominant_category"),
        F.when(F.col("unique_categories") > 1, F.round(F.col("mx") / F.col("mn"), 2)).otherwise(F.lit(1.0)).alias("imbalance_ratio"),
    )


def _bin_index(x, lo, hi, bins: int):
    """numpy.histogram bin of x for equal-width edges on [lo, hi] (last bin closed)."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    idx = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    edge = lo + idx.cast("double") * width
    nxt = F.when(idx + 1 == bins, hi).otherwise(lo + (idx + 1).cast("double") * width)
    idx = F.when(x < edge, idx - 1).when((x >= nxt) & (idx != bins - 1), idx + 1).otherwise(idx)
    return idx


def histogram(df: DataFrame, cols: Sequence[str] | str | None = None, bins: int = 20, by: str | None = None) -> DataFrame:
    """Equal-width histogram over non-NULL values, per column (and per ``by`` group for charts).

    Edges follow numpy: [min, max]; min == max -> [min - 0.5, max + 0.5]; no
    values -> [0, 1].  Every bin is reported, empty ones with count 0.  A ``by`` column named like one
    of the results gets underscores put before its name.
    """
    if isinstance(cols, str):
        cols = [cols]
    cols = numeric_columns(df, cols)
    shown = {"col_name": "col_name", "by": free_name(by or "by", ("col_name", "bin", "bin_start", "bin_end", "count"))}
    keys = ["col_name"] + (["by"] if by else [])
    structs = [F.struct(F.lit(c).alias("col_name"), q(c).cast("double").alias("x")) for c in cols]
    sel = [F.inline(F.array(*structs))]
    if by:
        sel = [q(by).alias("by")] + sel
    return binned(df.select(*sel), keys, bins, shown, F.count("*"))


def binned(long: DataFrame, keys: Sequence[str], bins: int, shown: dict[str, str], size: Column) -> DataFrame:
    """The histogram of ``x`` per ``keys`` (``col_name`` and perhaps ``by``); ``size`` counts the rows of a bin."""
    by = "by" in keys
    rng = long.groupBy(*keys).agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    lo = F.when(F.col("mn").isNull(), F.lit(0.0)).when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn"))
    hi = F.when(F.col("mx").isNull(), F.lit(1.0)).when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx"))
    rng = rng.select(*keys, lo.alias("lo"), hi.alias("hi"))
    rng = cut_lineage(rng) if by else rng
    rng_r = rng.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "lo", "hi")
    rng_b = F.broadcast(rng_r) if not by else bounded_broadcast(rng_r)  # one row per column (and group)
    counted = (
        long.where(F.col("x").isNotNull())
        .join(rng_b, [long[k].eqNullSafe(rng_b[f"_r_{k}"]) for k in keys])
        .select(*[long[c] for c in long.columns], _bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .groupBy(*keys, "bin").agg(size.alias("count"))
    )
    counted = counted.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("bin").alias("_c_bin"), "count")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.select(
        *keys, "bin",
        (F.col("lo") + F.col("bin").cast("double") * width).alias("bin_start"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1).cast("double") * width).alias("bin_end"),
    )
    out = grid.join(counted, [grid[k].eqNullSafe(counted[f"_c_{k}"]) for k in keys] + [grid["bin"] == counted["_c_bin"]], "left")
    return out.select(
        *[F.col(k).alias(shown[k]) for k in keys], F.col("bin").cast("int").alias("bin"), rnd(F.col("bin_start")).alias("bin_start"),
        rnd(F.col("bin_end")).alias("bin_end"), F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )
