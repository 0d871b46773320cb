import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8 and "skewness" in df.columns


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_streaming_apply(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarry.plans.runner import Step
    from quarry.queries.tables import table
    from quarry.streaming.stream import apply_to_stream, fit_steps

    from .conftest import SF

    batch = table(spark, SF, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    fitted = fit_steps(batch, [Step("standard_scaler", ("l_quantity",)), Step("log_transform", ("l_discount",))])
    full = table(spark, SF, "lineitem").schema
    stream = spark.readStream.schema(full).option("pathGlobFilter", "lineitem.parquet").parquet(SF).select(*batch.columns)
    q = apply_to_stream(stream, fitted).writeStream.format("memory").queryName("quarry_stream_test").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT avg(l_quantity) AS m FROM quarry_stream_test").first().m
    assert abs(got) < 1e-9
