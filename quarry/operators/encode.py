"""Encoding steps.

Label / ordinal codes are the position of the value in the sorted distinct
values.  The distinct values stay a DataFrame: they are numbered by the
bucketed global row number (no single-task window) and joined back by
``plans.splitjoin``: broadcast within a measured bound, beyond it shuffled
without the frequent values.  One-hot makes one
column per category, so the categories are collected; a caller may bound their
number (``max_categories``), which is then checked before anything is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import free_name, is_float, q
from ..plans.fitted import Fitted, step
from ..plans.guards import cut_lineage
from ..plans.ordered import global_row_number
from ..plans.splitjoin import Lookup, counted


def _as_text(df: DataFrame, c: str, null_token: str | None = None):
    """The one text form of a cell for encoding; NULL becomes its own category."""
    dt = df.schema[c].dataType
    token = null_token if null_token is not None else ("nan" if is_float(dt) else "None")
    return F.coalesce(q(c).cast("string"), F.lit(token))


def _dictionary(df: DataFrame, c: str, order: list | None = None, null_token=None) -> tuple[DataFrame, DataFrame]:
    """``value, code`` of the distinct text values of ``c`` (code-point order or ``order``), and ``value, n``, their rows."""
    counts = cut_lineage(counted(df, _as_text(df, c, null_token)))
    vals = counts.select("value")
    if order is not None:
        spark = df.sparkSession
        explicit = spark.createDataFrame([(str(v), i) for i, v in enumerate(order)], "value string, code long")
        rest = vals.join(F.broadcast(explicit), "value", "left_anti")
        ranked_rest = global_row_number(rest, ["value"], name="code").select(
            "value", (F.col("code") - 1 + len(order)).alias("code"))
        return explicit.unionByName(ranked_rest), counts
    return global_row_number(vals, ["value"], name="code").select("value", (F.col("code") - 1).alias("code")), counts


def _encode_apply(cols, lookups, out_type, null_token):
    def apply(d: DataFrame) -> DataFrame:
        out = d
        for c in cols:
            found = lookups[c].join(out, _as_text(out, c, null_token))
            code = F.col("code").cast(out_type)
            out = found.select(*[(code if n == c else F.col(f"c{i}")).alias(n) for i, n in enumerate(out.columns)])
        return out
    return apply


def _fit_codes(name, df, cols, out_type, order=None, null_token=None, **bounds):
    cols = [c for c in cols if c in df.columns]
    lookups, sizes = {}, {}
    for c in cols:
        dic, counts = _dictionary(df, c, order, null_token)
        dic = cut_lineage(dic)
        lookups[c], sizes[c] = Lookup(dic, counts, **bounds), dic.count()
    return Fitted(name, cols, _encode_apply(cols, lookups, out_type, null_token), values=sizes)


@step("label_encoder")
def fit_label_encoder(df: DataFrame, cols, null_token=None, **bounds):
    """Text form, sorted distinct values -> 0..k-1 (NULL is a category: 'nan' / 'None')."""
    return _fit_codes("label_encoder", df, cols, "long", None, null_token, **bounds)


@step("ordinal_encoder")
def fit_ordinal_encoder(df: DataFrame, cols, order=None, null_token=None, **bounds):
    """As label encoding with double codes; optional explicit ``order`` first, the rest sorted after it."""
    return _fit_codes("ordinal_encoder", df, cols, "double", order, null_token, **bounds)


@step("onehot_encoder")
def fit_onehot_encoder(df: DataFrame, cols, drop_first: bool = True, max_categories: int | None = None, **_):
    """Per column: sorted distinct non-NULL values, first dropped, boolean ``col_value`` columns
    appended in order, source column dropped; NULL -> all false.  A name that is taken gets underscores put before it
    (all names stay different).  ``max_categories`` is the caller's own bound."""
    cols = [c for c in cols if c in df.columns]
    cats = {}
    for c in cols:
        distinct = df.select(q(c)).where(q(c).isNotNull()).distinct()
        vals = (distinct if max_categories is None else distinct.limit(max_categories + 1)).collect()
        if max_categories is not None and len(vals) > max_categories:
            raise ValueError(f"onehot_encoder: {c} has more than {max_categories} categories")
        srt = sorted(v[0] for v in vals)
        cats[c] = srt[1:] if drop_first else srt

    def apply(d: DataFrame) -> DataFrame:
        names = [x for x in d.columns if x not in cols]
        keep, dummies = [q(x) for x in names], []
        for c in cols:
            for v in cats[c]:
                names.append(free_name(f"{c}_{v}", names))
                dummies.append(F.coalesce(q(c) == F.lit(v), F.lit(False)).alias(names[-1]))
        return d.select(*keep, *dummies)

    return Fitted("onehot_encoder", cols, apply, values={c: len(v) for c, v in cats.items()})


def label_encoder(df, cols, **kw):
    return fit_label_encoder(df, cols, **kw).apply(df)


def ordinal_encoder(df, cols, **kw):
    return fit_ordinal_encoder(df, cols, **kw).apply(df)


def onehot_encoder(df, cols, **kw):
    return fit_onehot_encoder(df, cols, **kw).apply(df)
