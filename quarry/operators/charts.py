"""Chart data, aggregated in Spark over the whole table.

The reference ships raw rows to the browser and lets the plotting library
aggregate; here each chart type is the aggregate itself, so the result size
depends on the number of groups, not on the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import free_name, q
from ..plans.guards import bounded_broadcast, cut_lineage
from ..plans.quantiles import exact_quantiles
from .values import histogram


def _keys(*cols):
    return [c for c in cols if c]


def _shown(cols: list[str], *results: str) -> list[str]:
    """Names of key columns beside ``results``: a name that is taken gets underscores put before it."""
    out: list[str] = []
    for c in cols:
        out.append(free_name(c, results, out))
    return out


def chart_bar(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Stacked bar heights: ``y`` = sum(y) per x (and color)."""
    keys = _keys(x, color)
    return df.groupBy(*[q(k).alias(n) for k, n in zip(keys, _shown(keys, "y"))]).agg(F.sum(q(y)).alias("y"))


def chart_pie(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Slice sizes: ``value`` = sum(y) per label, or the row count."""
    agg = F.sum(q(y)).cast("double") if y else F.count(F.lit(1)).cast("double")
    return df.groupBy(q(x).alias(*_shown([x], "value"))).agg(agg.alias("value"))


def chart_line(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Points ordered by (color, x): a distributed range sort, one trace per color."""
    keys = _keys(color, x)
    return df.select(*[q(c) for c in _keys(x, y, color)]).orderBy(*[q(k) for k in keys])


def chart_scatter(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
                  n: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The points of the requested columns that exist; all of them, or ``n`` where the caller asks for a limit.

    With ``order_by`` the first n rows of that order; otherwise an unbiased, repeatable
    choice by the hash of the row.  Either way it is a top-n (bounded per task)."""
    cols = [c for c in _keys(x, y, color, size) if c in df.columns]
    sel = df.select(*[q(c) for c in cols])
    if n is None:
        return sel
    key = [q(c) for c in order_by] if order_by else [F.xxhash64(*[q(c) for c in cols])] + [q(c) for c in cols]
    return sel.orderBy(*key).limit(n)


def chart_histogram(df: DataFrame, x: str, color: str | None = None, bins: int = 20) -> DataFrame:
    """Counts per equal-width bin (and color)."""
    return histogram(df, [x], bins=bins, by=color)


def chart_box(df: DataFrame, y: str, x: str | None = None, color: str | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles (exact), 1.5 IQR fences, whisker ends and extremes per group."""
    groups = _keys(x, color)
    keys = [f"g{i}" for i in range(max(len(groups), 1))]
    long = df.select(*([q(c).alias(g) for c, g in zip(groups, keys)] or [F.lit(1).alias("g0")]), q(y).cast("double").alias("v"))
    qs = exact_quantiles(long, [0.25, 0.5, 0.75], keys=keys)
    wide = qs.groupBy(*keys).agg(*[F.max(F.when(F.col("pi") == i, F.col("q"))).alias(nm) for i, nm in enumerate(("q1", "median", "q3"))])
    fences = wide.select(*keys, "q1", "median", "q3", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
                         (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper_fence"))
    fences = cut_lineage(fences)
    f2 = fences.select(*[F.col(c).alias(f"f_{c}") for c in keys], "lower_fence", "upper_fence")
    f2 = bounded_broadcast(f2)  # one row per group; the table itself stays where it is
    joined = long.join(f2, [long[c].eqNullSafe(f2[f"f_{c}"]) for c in keys])
    ext = joined.groupBy(*[long[c] for c in keys]).agg(
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.min(F.when(F.col("v") >= F.col("lower_fence"), F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= F.col("upper_fence"), F.col("v"))).alias("whisker_high"),
        F.sum(((F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence"))).cast("long")).alias("outliers"),
    )
    e2 = ext.select(*[F.col(c).alias(f"e_{c}") for c in keys], "min", "max", "whisker_low", "whisker_high", "outliers")
    out = fences.join(e2, [fences[c].eqNullSafe(e2[f"e_{c}"]) for c in keys])
    results = ("q1", "median", "q3", "lower_fence", "upper_fence", "min", "max", "whisker_low", "whisker_high")
    shown = [F.col(g).alias(n) for g, n in zip(keys, _shown(groups, *results, "outliers"))]
    return out.select(*shown, *[F.round(c, 6).alias(c) for c in results], "outliers")
