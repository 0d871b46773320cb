"""Correlations of many columns in one pass."""

import numpy as np
import pandas as pd
import pytest

from quarry.operators.profile import correlation_matrix, high_corr_pairs
from quarry.plans import crossproducts


def frame(seed, rows=400, cols=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, cols)) @ rng.normal(size=(cols, cols)) + 1e6 * rng.normal(size=cols)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 7.0  # constant
    x[:, 4] = np.nan  # empty
    x[1:, 5] = np.nan  # one value
    x[:, 6] = 2 * x[:, 7] + 1  # the same up to scale
    x[: rows // 2, 8], x[rows // 2 :, 9] = np.nan, np.nan  # no common row
    return pd.DataFrame(x, columns=[f"v.{i}" if i % 2 else f"i {i}" for i in range(cols)])


def values(pdf):
    return [[None if v != v else float(v) for v in r] for r in pdf.to_numpy()]


def test_sixty_columns_like_pandas(spark):
    pdf = frame(1)
    df = spark.createDataFrame(values(pdf), ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(4)
    got = {(r.col1, r.col2): r.correlation for r in correlation_matrix(df).collect()}
    assert len(got) == 3600
    with np.errstate(all="ignore"):
        want = pdf.corr()
    flat = [c for i, c in enumerate(pdf.columns) if i in (3, 4, 5)]
    for a in pdf.columns:
        for b in pdf.columns:
            w = None if a in flat or b in flat else want.loc[a, b]
            if w is None or w != w:
                assert got[a, b] is None, (a, b)
            else:
                assert got[a, b] == pytest.approx(w, abs=5.1e-4)
    best = high_corr_pairs(df, top=1).collect()
    assert [(best[0].col1, best[0].col2, best[0].correlation)] == [("i 6", "v.7", 1.0)]


def test_one_scan_after_the_means(spark, tmp_path):
    pdf = frame(2, 50)
    spark.createDataFrame(values(pdf), ", ".join(f"`{c}` double" for c in pdf.columns)).write.parquet(str(tmp_path / "t"))
    sums = crossproducts.cross_products(spark.read.parquet(str(tmp_path / "t")), list(pdf.columns))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1


def test_edges(spark):
    df = spark.createDataFrame([(1.0, float("inf"), 1), (2.0, 1.0, 2), (float("nan"), 2.0, 4)], "a double, b double, c int")
    got = {(r.col1, r.col2): r.correlation for r in correlation_matrix(df).collect()}
    assert got["a", "c"] == 1.0 and got["a", "a"] == 1.0 and got["a", "b"] is None and got["b", "b"] is None
    empty = correlation_matrix(df.limit(0)).collect()
    assert len(empty) == 9 and all(r.correlation is None for r in empty)
    assert correlation_matrix(df.select()).count() == 0
