import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import distribution as D
from quarry.operators import encode as E
from quarry.operators import impute as I
from quarry.operators import outliers as O
from quarry.operators import rows as R
from quarry.operators import scale as S
from quarry.operators import values as V
from quarry.plans.runner import Step, run_pipeline
from quarry.queries.tables import table

from .conftest import SF


def _df(spark, rows, schema="x double"):
    return spark.createDataFrame([(r,) for r in rows], schema)


def test_mode_tie_and_all_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert sorted(r.c for r in I.fillna_mode(df, ["c"]).collect()) == ["a", "a", "a", "b", "b"]
    nul = spark.createDataFrame([(None,), (None,)], "c string")
    assert [r.c for r in I.fillna_mode(nul, ["c"]).collect()] == ["Unknown", "Unknown"]


def test_constant_scaled_to_zero_including_null(spark):
    df = _df(spark, [5.0, 5.0, None])
    assert [r.x for r in S.standard_scaler(df, ["x"]).collect()] == [0.0, 0.0, 0.0]
    assert [r.x for r in S.minmax_scaler(df, ["x"]).collect()] == [0.0, 0.0, 0.0]


def test_log_sqrt_reciprocal(spark):
    got = [r.x for r in D.log_transform(_df(spark, [-1.0, 0.0, 3.0]), ["x"]).collect()]
    assert np.allclose(got, [math.log(2), math.log(3), math.log(6)])
    got = [r.x for r in D.sqrt_transform(_df(spark, [-4.0, 0.0, 5.0]), ["x"]).collect()]
    assert np.allclose(got, [0, 2, 3])
    assert D.reciprocal_transform(_df(spark, [0.0]), ["x"]).first().x == pytest.approx(1e6)


def test_iqr_drops_nulls(spark):
    out = O.fit_remove_outliers_iqr(_df(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None]), ["x"]).apply(_df(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None]))
    assert sorted(r.x for r in out.collect()) == [1.0, 2.0, 3.0, 4.0]


def test_clip_keeps_nulls(spark):
    out = O.clip_outliers(_df(spark, [1.0, None, 3.0, 100.0]), ["x"], 0.1, 0.9)
    assert any(r.x is None for r in out.collect())


def test_onehot(spark):
    df = spark.createDataFrame([("r",), ("g",), ("b",), (None,)], "c string")
    out = E.onehot_encoder(df, ["c"])
    assert out.columns == ["c_g", "c_r"]
    assert [tuple(r) for r in out.collect()][-1] == (False, False)


def test_label_encoding_round_trip(spark):
    df = table(spark, SF, "orders")
    enc = E.label_encoder(df, ["o_orderpriority"]).select("o_orderkey", F.col("o_orderpriority").alias("code"))
    j = enc.join(df.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    pairs = {(r.code, r.o_orderpriority) for r in j.collect()}
    assert sorted(pairs) == list(enumerate(sorted({p for _, p in pairs})))


def test_histogram_single_value(spark):
    h = V.histogram(_df(spark, [2.0, 2.0]), ["x"], bins=20).orderBy("bin").collect()
    assert h[0].bin_start == 1.5 and h[-1].bin_end == 2.5 and sum(r["count"] for r in h) == 2


def test_histogram_counts_sum_to_non_null(spark):
    df = table(spark, SF, "lineitem_gappy")
    h = V.histogram(df, ["price_n"], bins=20).agg(F.sum("count")).first()[0]
    assert h == df.where(F.col("price_n").isNotNull()).count()


def _boxcox_llf(x, lam):
    y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


def test_boxcox_lambda_matches_numpy_golden_section(spark):
    df = table(spark, SF, "events")
    fitted = D.fit_boxcox_transform(df, ["value"])
    lam = fitted.values["value"]["lambda"]
    x = df.select("value").toPandas().value.to_numpy()
    a, b = -2.0, 2.0
    g = (math.sqrt(5) - 1) / 2
    for _ in range(200):
        c, d = b - g * (b - a), a + g * (b - a)
        if _boxcox_llf(x, c) > _boxcox_llf(x, d):
            b = d
        else:
            a = c
    assert abs(lam - (a + b) / 2) < 1e-3


def test_pipeline_keeps_steps_before_failure(spark):
    df = table(spark, SF, "orders_gappy")
    steps = [Step("fillna_median", ("price_n",)), Step("no_such_step", ("price_n",)), Step("standard_scaler", ("price_n",))]
    out, log = run_pipeline(df, steps)
    rows = log.collect()
    assert [r.status for r in rows] == ["success", "failed"]
    assert out.where(F.col("price_n").isNull()).count() == 0
    out2, _ = run_pipeline(df, steps, atomic=True)
    assert out2.where(F.col("price_n").isNull()).count() > 0


def test_selectors(spark):
    from quarry.functions.columns import resolve_columns

    assert resolve_columns(["a", "b"], "include", ["b", "zz"]) == ["b"]
    assert resolve_columns(["a", "b", "new"], "exclude", ["a"]) == ["b", "new"]
    assert resolve_columns(["a", "t"], "include", ["__ALL_EXCEPT_TARGET__"], target="t") == ["a"]


def test_dedupe_subset_keeps_first(spark):
    df = table(spark, SF, "documents")
    out = R.drop_duplicates_subset(df, ["text"], ["doc_id"])
    exp = df.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in exp.collect())
