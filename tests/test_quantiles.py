import numpy as np
import pytest

from quarry.plans import quantiles as Q
from quarry.queries.tables import table

from .conftest import SF

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_direct_matches_pandas(spark):
    df = table(spark, SF, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    pdf = df.select(cols).toPandas()
    got = Q.column_quantiles(df, cols, PROBS)
    for c in cols:
        assert np.allclose(got[c], [pdf[c].quantile(p) for p in PROBS], rtol=0, atol=1e-9)


@pytest.mark.parametrize("limit", [1, 300, 5000])
def test_refinement_matches_pandas(spark, limit):
    """Intervals split by several rounds of counts give the same numbers."""
    df = table(spark, SF, "lineitem_gappy")
    long = Q.long_format(df, ["price_n", "l_tax"])
    rows = Q.exact_quantiles(long, PROBS, limit=limit).collect()
    pdf = df.select("price_n", "l_tax").toPandas()
    for r in rows:
        assert abs(r["q"] - pdf[r["key"]].quantile(r["p"])) < 1e-9


def test_grouped_keys_with_hot_group(spark):
    """One group holding most rows (hot key) still yields exact per-group quantiles."""
    from pyspark.sql import functions as F

    df = table(spark, SF, "lineitem").select(
        F.when(F.col("l_linenumber") <= 5, F.lit("hot")).otherwise(F.col("l_returnflag")).alias("g"),
        F.col("l_extendedprice").alias("v"))
    got = Q.exact_quantiles(df, [0.1, 0.5, 0.9], keys=["g"], limit=2000).collect()
    pdf = df.toPandas()
    for r in got:
        exp = pdf[pdf.g == r["g"]].v.quantile(r["p"])
        assert abs(r["q"] - exp) < 1e-9


def test_all_null_column_gives_no_rows(spark):
    from pyspark.sql import functions as F

    df = table(spark, SF, "region").select(F.lit(None).cast("double").alias("x"))
    assert Q.column_quantiles(df, ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("limit", [1, 100, 10**6])
def test_zero_heavy_wide_and_signed(spark, limit):
    """Zeros between negatives and positives, huge exponents, NULL keys, 1001 knots."""
    import pandas as pd

    values = [-float(i) for i in range(1, 6)] + [0.0] * 3000 + [float(i) for i in range(1, 6)] + [1e300, -1e300, 5e-324, 1e-7]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, v * 2) for v in values[::3]], "key string, v double")
    probs = [j / 1000 for j in range(1001)]
    pdf = df.toPandas()
    for r in Q.exact_quantiles(df, probs, limit=limit).collect():
        of = pdf[pdf.key.isna()] if r["key"] is None else pdf[pdf.key == r["key"]]
        want = np.quantile(of.v.to_numpy(), r["p"])
        assert r["n"] == len(of) and abs(r["q"] - want) <= 1e-9 * max(1, abs(want)), r


def test_plan_does_not_grow_with_ranks(spark):
    """No aggregate per rank: 1001 knots plan as few aggregate expressions as 3."""
    df = table(spark, SF, "lineitem").select(F_lit("x"), "l_extendedprice").toDF("key", "v")
    plan = Q.exact_quantiles(df, [j / 1000 for j in range(1001)], limit=500)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max(") + plan.count("count(") < 40


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


@pytest.mark.parametrize("limit", [1, 50, 10**6])
def test_columns_with_nan_infinity_and_hard_values(spark, limit):
    """Whole columns: every rank of awkward values, several rounds of slices, NaN and NULL left out."""
    rng = np.random.default_rng(limit)
    inf = float("inf")
    cols = {
        "nan": [float("nan"), 3.0, 1.0, None], "inf": [1.0, 2.0, inf], "both": [-inf, -inf, 0.0, 5.0, inf],
        "powers": [s * 2.0**e for e in range(-40, 41) for s in (1, -1)] + [s * (2.0**e) * (1 - 2**-53) for e in range(-5, 9) for s in (1, -1)],
        "tiny": [5e-324, 1e-310, -5e-324, 1e308, -1e308, 0.0, -0.0], "near": (1 + rng.integers(0, 400, 500) * 2.0**-52).tolist(),
        "mixed": (rng.normal(size=700) * 10.0 ** rng.integers(-3, 4, 700)).tolist(), "none": [None],
    }
    longest = max(map(len, cols.values()))
    rows = list(zip(*[v + [None] * (longest - len(v)) for v in cols.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(3)
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.77, 1.0]
    got = Q.column_quantiles(df, list(cols), probs, limit=limit)
    for c, values in cols.items():
        v = sorted(x for x in values if x is not None and x == x)
        for k, p in enumerate(probs):
            if not v:
                assert got[c][k] is None
                continue
            h = (len(v) - 1) * p
            lo, hi = v[int(h)], v[min(int(h) + 1, len(v) - 1)]
            want = lo if h == int(h) or lo == hi else hi - (hi - lo) * (1 - (h - int(h))) if h - int(h) >= 0.5 else lo + (hi - lo) * (h - int(h))
            assert got[c][k] == want or (want != want and got[c][k] != got[c][k]), (c, p)
    long = Q.long_format(df, ["nan", "inf"])
    by_key = {(r["key"], r["pi"]): r["q"] for r in Q.exact_quantiles(long, [0.0, 0.5]).collect()}
    assert by_key == {("nan", 0): 1.0, ("nan", 1): 2.0, ("inf", 0): 1.0, ("inf", 1): 2.0}
