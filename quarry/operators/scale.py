"""Scaling steps: one fused fit aggregate, literal-only apply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, q
from ..plans.fitted import Fitted, Request, planned


def _d(c):
    return q(c).cast("double")


def _request(name: str, df: DataFrame, cols, stats: dict, scaled, probs=(), method: str = "exact") -> Request:
    """A step that maps each numeric column by ``scaled(x, *answers)`` (None: left as it is); ``stats`` are
    aggregates of x by name, ``probs`` quantiles, and the answers come in that order."""
    num = numeric_columns(df, cols)

    def build(values, quantiles):
        st = {c: [values[f"{k}{i}"] for k in stats] + quantiles.get(c, []) for i, c in enumerate(num)}

        def apply(d):
            out = {c: scaled(_d(c), *st[c]) for c in num}
            out = {c: x for c, x in out.items() if x is not None}
            return d.withColumns(out) if out else d

        return Fitted(name, num, apply, [c for c in cols if c not in num], values={c: v[0] if len(v) == 1 else tuple(v) for c, v in st.items()})

    aggs = {f"{k}{i}": f(_d(c)) for k, f in stats.items() for i, c in enumerate(num)}
    return Request(num, build, aggs, {c: list(probs) for c in num} if probs else {}, method)


@planned("standard_scaler")
def fit_standard_scaler(df: DataFrame, cols, **_):
    """(x - mean) / sample std; zero std -> 0 on every row, NULL rows included."""

    def scaled(x, m, s):
        return F.lit(0.0) if s == 0 else (x - F.lit(m)) / F.lit(s) if s is not None else x * F.lit(None).cast("double")

    return _request("standard_scaler", df, cols, {"m": F.avg, "s": F.stddev_samp}, scaled)


@planned("minmax_scaler")
def fit_minmax_scaler(df: DataFrame, cols, **_):
    """(x - min) / (max - min); constant -> 0 on every row, NULL rows included."""

    def scaled(x, lo, hi):
        return None if lo is None else F.lit(0.0) if hi == lo else (x - F.lit(lo)) / F.lit(hi - lo)

    return _request("minmax_scaler", df, cols, {"a": F.min, "b": F.max}, scaled)


@planned("robust_scaler")
def fit_robust_scaler(df: DataFrame, cols, quantile_method="exact", **_):
    """(x - median) / (q75 - q25); zero IQR divides by 1."""

    def scaled(x, q1, med, q3):
        return None if med is None else (x - F.lit(med)) / F.lit((q3 - q1) or 1.0)

    return _request("robust_scaler", df, cols, {}, scaled, (0.25, 0.5, 0.75), quantile_method)


@planned("maxabs_scaler")
def fit_maxabs_scaler(df: DataFrame, cols, **_):
    """x / max |x|; zero maximum divides by 1."""
    return _request("maxabs_scaler", df, cols, {"a": lambda x: F.max(F.abs(x))}, lambda x, a: None if a is None else x / F.lit(a or 1.0))


@planned("unit_vector_scaler")
def fit_unit_vector_scaler(df: DataFrame, cols, **_):
    """Divide each row by its L2 norm over the columns (stateless); zero rows unchanged.

    A NULL cell counts as 0 in the norm and stays NULL (the reference's library rejects NULLs)."""
    num = numeric_columns(df, cols)

    def apply(d):
        if not num:
            return d
        norm = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.coalesce(_d(c), F.lit(0.0)), 2) for c in num]))
        return d.withColumns({c: F.when(norm == 0, _d(c)).otherwise(_d(c) / norm) for c in num})

    return Request(num, lambda *_: Fitted("unit_vector_scaler", num, apply, [c for c in cols if c not in num]))


def standard_scaler(df, cols):
    return fit_standard_scaler(df, cols).apply(df)


def minmax_scaler(df, cols):
    return fit_minmax_scaler(df, cols).apply(df)


def robust_scaler(df, cols):
    return fit_robust_scaler(df, cols).apply(df)


def maxabs_scaler(df, cols):
    return fit_maxabs_scaler(df, cols).apply(df)


def unit_vector_scaler(df, cols):
    return fit_unit_vector_scaler(df, cols).apply(df)
