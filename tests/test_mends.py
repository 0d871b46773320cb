"""Names with dots and backticks, settings, keyed split files, uncapped results, fitted bounds."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.columns import nan_to_null
from quarry.operators import charts, encode, outliers, rules, values
from quarry.plans import guards
from quarry.plans.runner import Step, run_pipeline
from quarry.sources import io


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1.5, "x", "u"), (float("nan"), "y", None)], "`a.b` double, `c.d` string, `e``f` string")
    assert [r[0] for r in nan_to_null(df).collect()] == [1.5, None]
    assert [r[0] for r in encode.label_encoder(df, ["c.d"]).select("`c.d`").collect()] == [0, 1]
    assert encode.label_encoder(df, ["c.d", "e`f"]).columns == df.columns
    two = spark.createDataFrame([("a`b",), ("ab",), ("c",)], "c string")
    assert encode.onehot_encoder(two, ["c"]).columns == ["c_ab", "c_c"] or len(set(encode.onehot_encoder(two, ["c"]).columns)) == 2


def test_onehot_has_no_bound_of_its_own(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("c"))
    assert len(encode.onehot_encoder(df, ["c"]).columns) == 1499
    with pytest.raises(ValueError):
        encode.fit_onehot_encoder(df, ["c"], max_categories=10)


def test_dedupe_names():
    assert io.dedupe_names(["k", "a", "k", "k"]) == ["k", "a", "k.1", "k.2"]
    assert io.dedupe_names(["a", "a", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"]
    assert io.dedupe_names([]) == []


def test_settings_are_kept(spark):
    from quarry.session import configure

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        configure(spark)
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_one_gap_in_many_rows_is_seen(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") != 5, F.col("id") % 7).alias("v"), F.lit(1).alias("one"))
    said = [r.insight for r in rules.data_insights(df).orderBy("idx").collect()]
    assert said[1].startswith("1 columns have gaps, most of all v") and said[-1].endswith("the first is one")
    steps = {r.step: r.affected_columns for r in rules.suggest_steps(df).collect()}
    assert steps["fillna_median"] == steps["dropna_rows"] == "v"
    assert {r.col_name: r.suggestion for r in rules.column_advice(df).collect()}["v"] == rules.ADVICE_IMPUTE_NUMERIC
    wide = spark.range(50).select(*[F.when(F.col("id") != i, 1.0).alias(f"c{i:02d}") for i in range(14)])
    listed = {r.step: r.affected_columns for r in rules.suggest_steps(wide).collect()}["dropna_rows"]
    assert listed == ",".join(f"c{i:02d}" for i in range(14))


def test_nothing_is_cut(spark):
    df = spark.createDataFrame([("x" * 60 + "1", 1.0), ("x" * 60 + "2", 2.0)], "s string, v double")
    assert {len(r.value) for r in values.top_values(df).collect()} == {61}
    many = spark.range(6000).select("id", (F.col("id") * 2).alias("y"))
    assert charts.chart_scatter(many, "id", "y").count() == 6000 and charts.chart_scatter(many, "id", "y", n=10).count() == 10
    long = "z" * 900
    _, log = run_pipeline(df, [Step(long)])
    assert long in log.first()["message"]


def test_broadcasts_are_bounded_in_bytes(spark):
    few = spark.createDataFrame([("x" * 1000,)] * 10, "s string")
    assert guards.measured_bytes(few) >= 10_000
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(guards.bounded_broadcast(few)) and "broadcast" not in plan(guards.bounded_broadcast(few, 5000))


def test_outlier_bounds_are_fitted_once(spark):
    df = spark.createDataFrame([(float(x), float(x % 3)) for x in [*range(20), 500]], "x double, y double")
    fit = outliers.fit_remove_outliers_iqr(df, ["x", "y"])
    other = spark.createDataFrame([(10.0, 1.0), (400.0, 1.0), (None, 1.0)], "x double, y double")
    assert [r.x for r in fit.apply(other).collect()] == [10.0] and set(fit.values) == {"x", "y"}


def test_registered_sweeps_train_all_candidates(spark):
    import __spark_entry__ as E

    from .conftest import SF_SMALL

    found = {k: [(r.depth, r.layers) for r in E.queries()[k](spark, SF_SMALL).collect()] for k in ("model_sweep", "model_sweep_regression")}
    assert [d for d, _ in found["model_sweep"]] == [1, 1, 2, 2, 2, 2] and len(set(found["model_sweep"])) == 6
    assert found["model_sweep_regression"] == [(1, "5"), (1, "10"), (2, "5"), (2, "10")]


def test_regression_sweep(spark):
    from quarry.operators.sweep import model_sweep

    df = spark.range(200).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 2 + F.col("b") + 5)
    out = model_sweep(df, df, ["a", "b"], "y", depths=(2,), units=(2, 5), task="regression").collect()
    assert len(out) == 2 and all(0.5 < r.reward <= 1 for r in out)
