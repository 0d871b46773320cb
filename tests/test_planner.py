"""Runs of many steps: same results as step by step, few jobs, few scans."""

import pytest
from pyspark.sql import functions as F

from quarry.plans.fitted import STEP_FITTERS
from quarry.plans.runner import Step, run_pipeline
from quarry.queries.steps_q import PIPE_STEPS
from quarry.queries.tables import table

from .conftest import SF_SMALL


def one_by_one(df, steps):
    for st in steps:
        df = STEP_FITTERS[st.op](df, [c for c in st.columns if c in df.columns], **st.params).apply(df)
    return df


def numbers(spark, n=400, cols=12):
    cells = [F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9)) != 0, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000 + k)) / 7.0).alias(f"v{k}") for k in range(cols)]
    return spark.range(n).select("id", *cells, (F.col("id") % 4).cast("string").alias("t"))


def same(a, b):
    assert a.columns == b.columns
    x, y = ([[round(v, 9) if isinstance(v, float) else v for v in r] for r in d.orderBy("id").collect()] for d in (a, b))
    assert x == y


RUNS = [
    [Step("fillna_median", ("v0",)), Step("clip_outliers", ("v0",), {"lower": 0.1, "upper": 0.9}), Step("standard_scaler", ("v0", "v1")), Step("derive", (), {"name": "z", "expr": "v0 * 2"}), Step("minmax_scaler", ("z", "v2"))],
    [Step("fillna_mean", ("v0", "v1")), Step("minmax_scaler", ("v2",)), Step("drop_columns", ("v3",)), Step("maxabs_scaler", ("v4",)), Step("robust_scaler", ("v0",))],
    [Step("standard_scaler", ("v0",)), Step("dropna_rows", (), {"subset": ["v0", "v1"]}), Step("minmax_scaler", ("v1",)), Step("remove_outliers_iqr", ("v2", "v5")), Step("log_transform", ("v2",)), Step("sqrt_transform", ("v3",))],
    [Step("fillna_ffill", ("v0", "v1"), {"order_by": ["id"]}), Step("standard_scaler", ("v0",)), Step("drop_duplicates_subset", ("t",), {"order_by": ["id"]}), Step("minmax_scaler", ("v1", "v0")), Step("label_encoder", ("t",)), Step("unit_vector_scaler", ("v2", "v3"))],
    [Step("fillna_mode", ("t", "v0")), Step("reciprocal_transform", ("v0",)), Step("winsorize_outliers", ("v0", "v1"), {"limits": 0.1}), Step("boxcox_transform", ("v5",)), Step("quantile_transform", ("v6",), {"n_quantiles": 20}), Step("derive", (), {"name": "v7", "expr": "v7 + v0"}), Step("standard_scaler", ("v7", "v6"))],
]


@pytest.mark.parametrize("steps", RUNS)
def test_same_as_one_by_one(spark, steps):
    df = numbers(spark)
    out, log = run_pipeline(df, steps)
    assert [r.status for r in log.orderBy("step").collect()] == ["success"] * len(steps)
    same(out, one_by_one(df, steps))


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("planner", "planner")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup("planner"))
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(tracker.getJobIdsForGroup("planner")) - before


def test_ten_fits_share_one_job(spark):
    df = numbers(spark).coalesce(1)
    kinds = ["fillna_mean", "standard_scaler", "minmax_scaler", "maxabs_scaler", "log_transform", "sqrt_transform", "fillna_mean", "standard_scaler", "minmax_scaler", "maxabs_scaler"]
    steps = [Step(op, (f"v{i}",)) for i, op in enumerate(kinds)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # otherwise a shuffle and what follows it count as two jobs
    try:
        (out, _), jobs = jobs_of(spark, lambda: run_pipeline(df, steps))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert jobs == 1
    same(out, one_by_one(df, steps))


def test_registered_run_scans_its_source_twice(spark):
    source = table(spark, SF_SMALL, "orders_gappy")
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = source.mapInArrow(through, source.schema)
    out, log = run_pipeline(counted, PIPE_STEPS)
    out.write.format("noop").mode("overwrite").save()
    assert seen.value == 2 * source.count()
    assert {r.status for r in log.collect()} == {"success"}


def test_failures_keep_what_came_before(spark):
    df = numbers(spark)
    good = [Step("standard_scaler", ("v0",)), Step("minmax_scaler", ("v1",))]
    for bad in (Step("no_such", ("v2",)), Step("boxcox_transform", ("c",)), Step("fillna_ffill", ("v3",)), Step("clip_outliers", ("v2",), {"lower": "x"})):
        with_constant = df.withColumn("c", F.lit(1.0))
        out, log = run_pipeline(with_constant, [*good, bad, Step("minmax_scaler", ("v5",))])
        assert [(r.step, r.status) for r in log.orderBy("step").collect()] == [(1, "success"), (2, "success"), (3, "failed")]
        same(out, one_by_one(with_constant, good))
        assert run_pipeline(with_constant, [*good, bad], atomic=True)[0] is with_constant
    # a fit that only fails when it runs, among steps that share its job
    huge = spark.createDataFrame([(1, "9" * 37, 1.0), (2, "9" * 37, 2.0)], "id long, d string, v double").select("id", F.col("d").cast("decimal(38,0)").alias("d"), "v")
    odd = [Step("minmax_scaler", ("v",)), Step("derive", (), {"name": "w", "expr": "v / (id - 1)"}), Step("standard_scaler", ("w",))]
    out, log = run_pipeline(huge, odd)
    assert [r.status for r in log.orderBy("step").collect()] == ["success", "success", "failed"]
    assert out.columns == ["id", "d", "v", "w"]
    assert run_pipeline(df, [])[0] is df
