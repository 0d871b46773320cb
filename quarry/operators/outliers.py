"""Outlier steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, q
from ..functions.exprs import clip
from ..plans.fitted import Fitted, Request, planned, step
from ..plans.guards import cut_lineage, spread
from ..plans.quantiles import column_quantiles


def _key_columns(df: DataFrame, num: list[str]) -> DataFrame:
    """The columns that the fits read; written once where there are several fits over ever fewer rows."""
    keys = df.select(*[q(c) for c in num])
    return cut_lineage(spread(keys)) if len(num) > 1 else keys


def _keep(bounds: dict):
    """Filter by fitted (low, high, closed) bounds per column; NULL bounds keep nothing, NULL rows drop."""

    def apply(d: DataFrame) -> DataFrame:
        for c, (lo, hi, closed) in bounds.items():
            if lo is None:
                return d.where(F.lit(False))
            d = d.where(q(c).between(F.lit(lo), F.lit(hi)) if closed else (q(c) > F.lit(lo)) & (q(c) < F.lit(hi)))
        return d

    return apply


@step("remove_outliers_iqr")
def fit_remove_outliers_iqr(df: DataFrame, cols, multiplier: float = 1.5, quantile_method: str = "exact", **_):
    """Keep Q1 - m IQR <= x <= Q3 + m IQR; each column's quartiles are fitted on the rows that the
    previous columns keep (k columns = k fits)."""
    bounds: dict = {}
    num = numeric_columns(df, cols)
    keys = _key_columns(df, num)
    for c in num:
        q1, q3 = column_quantiles(_keep(bounds)(keys), [c], [0.25, 0.75], method=quantile_method)[c]
        spread = None if q1 is None else float(multiplier) * (q3 - q1)
        bounds[c] = (None, None, True) if q1 is None else (q1 - spread, q3 + spread, True)
    return Fitted("remove_outliers_iqr", list(bounds), _keep(bounds), [c for c in cols if c not in bounds], values=bounds)


@step("remove_outliers_zscore")
def fit_remove_outliers_zscore(df: DataFrame, cols, threshold: float = 3.0, **_):
    """Keep |x - mean| / std_pop < threshold, fitted like the above; zero spread keeps nothing."""
    bounds: dict = {}
    num = numeric_columns(df, cols)
    keys = _key_columns(df, num)
    for c in num:
        r = _keep(bounds)(keys).agg(F.avg(q(c)).alias("m"), F.stddev_pop(q(c)).alias("s")).first()
        far = None if r["m"] is None or not r["s"] else float(threshold) * r["s"]
        bounds[c] = (None, None, False) if far is None else (r["m"] - far, r["m"] + far, False)
    return Fitted("remove_outliers_zscore", list(bounds), _keep(bounds), [c for c in cols if c not in bounds], values=bounds)


def _clip_apply(bounds: dict):
    def apply(d: DataFrame) -> DataFrame:
        return d.withColumns({c: clip(q(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items() if lo is not None})
    return apply


@planned("clip_outliers")
def fit_clip_outliers(df: DataFrame, cols, lower: float = 0.01, upper: float = 0.99, quantile_method="exact", **_):
    num = numeric_columns(df, cols)

    def build(_, quantiles):
        bounds = {c: tuple(quantiles[c]) for c in num}
        return Fitted("clip_outliers", num, _clip_apply(bounds), [c for c in cols if c not in num], values=bounds)

    return Request(num, build, quantiles={c: [float(lower), float(upper)] for c in num}, method=quantile_method)


@step("winsorize_outliers")
def fit_winsorize_outliers(df: DataFrame, cols, limits: float = 0.05, **_):
    """Clip each tail to the order statistic k = int(limits * n) from that end (non-NULL values)."""
    num = numeric_columns(df, cols)
    bounds, probs = {}, {}
    if num:
        counts = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(num)]).first()
        for i, c in enumerate(num):
            n = counts[f"n{i}"]
            k = int(float(limits) * n)
            if n > 1 and k:
                probs[c] = (k / (n - 1), (n - 1 - k) / (n - 1))
        asked = sorted({p for both in probs.values() for p in both})
        found = column_quantiles(df, list(probs), asked) if probs else {}  # one fit for all columns
        bounds = {c: tuple(found[c][asked.index(p)] for p in both) for c, both in probs.items()}
    return Fitted("winsorize_outliers", num, _clip_apply(bounds), [c for c in cols if c not in num], values=bounds)


def clip_outliers(df, cols, lower=0.01, upper=0.99):
    return fit_clip_outliers(df, cols, lower, upper).apply(df)


def winsorize_outliers(df, cols, limits=0.05):
    return fit_winsorize_outliers(df, cols, limits).apply(df)
