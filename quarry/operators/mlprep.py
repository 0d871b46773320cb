"""ML preparation and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import free_names, numeric_columns, q
from ..plans.guards import cut_lineage
from ..plans.ordered import first_rows, global_row_number
from ..plans.splitjoin import Lookup, counted

EPS = 2.220446049250313e-16  # float64 machine epsilon, the MAPE divisor floor


def _with_split(flagged: DataFrame, names: list[str], split) -> DataFrame:
    """The columns ``names`` and ``split`` (which takes the place of a column of that name)."""
    return flagged.select(*[q(c) for c in names if c.lower() != "split"], split.alias("split"))


def split_time(df: DataFrame, time: str, ratio: float = 0.2, tiebreak: list[str] | None = None, **kw) -> DataFrame:
    """Sort by ``time`` (then ``tiebreak``), undated rows last; the first int(n (1 - ratio)) rows are train, the rest validation.

    Adds ``split`` ('train' / 'val').  Rows are compared with the key at the cut; they don't move."""
    n = df.count()
    undated, first = free_names(df.columns, "undated", "first")
    d = df.withColumn(undated, q(time).isNull())
    flagged = first_rows(d, [undated, time, *(tiebreak or [])], int(n * (1 - ratio)), first, n, **kw)
    return _with_split(flagged, df.columns, F.when(q(first), "train").otherwise("val"))


def split_random(df: DataFrame, key: str | list[str], ratio: float = 0.2, seed: int = 42, **kw) -> DataFrame:
    """Exact-size repeatable random split: validation = the ceil(n ratio) rows with the smallest
    md5(key || seed); adds ``split``.  Unlike ``randomSplit`` the sizes are exact."""
    keys = [key] if isinstance(key, str) else list(key)
    n = df.count()
    h = F.md5(F.concat_ws("|", *[q(k).cast("string") for k in keys], F.lit(str(seed))))
    digest, first = free_names(df.columns, "digest", "first")
    flagged = first_rows(df.withColumn(digest, h), [digest, *keys], math.ceil(n * ratio), first, n, **kw)
    return _with_split(flagged, df.columns, F.when(q(first), "val").otherwise("train"))


def split_shapes(split_df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Shapes of X_train, y_train, X_val, y_val (features kept numeric only)."""
    nf = len(numeric_columns(split_df, features))
    c = split_df.groupBy("split").count().collect()
    cnt = {r["split"]: r["count"] for r in c}
    rows = [("X_train", cnt.get("train", 0), nf), ("y_train", cnt.get("train", 0), 1),
            ("X_val", cnt.get("val", 0), nf), ("y_val", cnt.get("val", 0), 1)]
    return split_df.sparkSession.createDataFrame(rows, "part string, rows long, cols long")


def encode_target(train: DataFrame, val: DataFrame, col: str, out: str | None = None, **bounds):
    """Codes of a non-numeric target from the *training* dictionary (sorted), applied to both
    sides; unseen validation values get -1.  Returns (train, val, n_classes)."""
    out = out or col
    counts = cut_lineage(counted(train, q(col).cast("string")))
    dic = cut_lineage(global_row_number(counts.select("value"), ["value"], name="code").select("value", (F.col("code") - 1).alias("code")))
    lookup = Lookup(dic, counts, **bounds)

    def enc(d):
        found = lookup.join(d, q(col).cast("string"))
        back = found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(d.columns)], F.coalesce("code", F.lit(-1)).cast("long").alias("\0code"))
        return back.withColumn(out, q("\0code")).drop("\0code")

    return enc(train), enc(val), dic.count()


def eval_classification(df: DataFrame, label: str, pred: str, threshold: float | None = None) -> DataFrame:
    """accuracy, support-weighted precision and recall (0 for a class never predicted)."""
    p = (q(pred) > threshold).cast("long") if threshold is not None else q(pred)
    conf = df.select(q(label).alias("y"), p.alias("p")).groupBy("y", "p").count()  # classes^2 rows
    lab = conf.groupBy("y").agg(F.sum("count").alias("support"),
                                F.sum(F.when(F.col("y") == F.col("p"), F.col("count"))).alias("tp"))
    prd = conf.groupBy(F.col("p").alias("y")).agg(F.sum("count").alias("predicted"))
    j = lab.join(prd, "y", "left")
    tp = F.coalesce(F.col("tp"), F.lit(0))
    prec = F.when(F.col("predicted") > 0, tp / F.col("predicted")).otherwise(F.lit(0.0))
    rec = tp / F.col("support")
    n = F.sum("support")
    return j.agg(
        F.round(F.sum(tp) / n, 6).alias("accuracy"),
        F.round(F.sum(prec * F.col("support")) / n, 6).alias("precision"),
        F.round(F.sum(rec * F.col("support")) / n, 6).alias("recall"),
    )


def eval_regression(df: DataFrame, label: str, pred: str) -> DataFrame:
    """R^2, RMSE, MAPE and 1 - MAPE in one aggregate (after the label mean)."""
    y, p = q(label).cast("double"), q(pred).cast("double")
    df = df.where(y.isNotNull() & p.isNotNull())  # incomplete pairs tell nothing, the mean included
    mean = df.agg(F.avg(y)).first()[0]
    agg = df.agg(
        F.sum(F.pow(y - p, 2)).alias("ss_res"), F.sum(F.pow(y - F.lit(mean), 2)).alias("ss_tot"),
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape"),
    )
    r2 = F.when(F.col("ss_tot") != 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(F.lit(0.0))
    return agg.select(F.round(r2, 6).alias("r2"), F.round(F.sqrt(F.col("ss_res") / F.col("n")), 6).alias("rmse"),
                      F.round("mape", 6).alias("mape"), F.round(1 - F.col("mape"), 6).alias("one_minus_mape"))


def history_best(history: DataFrame, reward: str = "reward", depth: str = "depth", top: int = 1) -> DataFrame:
    """Best ``top`` candidates per depth plus the best overall (``scope`` = 'overall' / 'depth')."""
    w = Window.partitionBy(q(depth)).orderBy(q(reward).desc(), F.col("candidate"))
    per = history.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("scope", F.lit("depth"))
    best = history.orderBy(q(reward).desc(), F.col("candidate")).limit(top)  # top-n: bounded per task
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(q(reward).desc(), F.col("candidate"))))  # <= top rows
    return per.unionByName(best.withColumn("scope", F.lit("overall")))
