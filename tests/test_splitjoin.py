"""Dictionaries beyond the broadcast bound: whatever one key holds, no task gets it all."""

from statistics import median

from pyspark.sql import functions as F

from quarry.operators import encode, mlprep
from quarry.plans import splitjoin


def skewed(spark, n=40_000):
    """Half of the rows hold one value, a tenth none, the rest are all different."""
    key = F.when(F.col("id") % 10 < 5, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("k"), F.col("id")))
    return spark.range(0, n, 1, 8).select("id", key.alias("k"))


def test_same_codes_broadcast_or_split(spark):
    df = skewed(spark, 3000)
    for fit in (encode.label_encoder, encode.ordinal_encoder):
        whole = {r.id: r.k for r in fit(df, ["k"]).collect()}
        assert {r.id: r.k for r in fit(df, ["k"], max_bytes=0).collect()} == whole
    want = {v: i for i, v in enumerate(sorted({r.k or "None" for r in df.collect()}))}
    assert whole == {r.id: want[r.k or "None"] for r in df.collect()}
    order = encode.ordinal_encoder(df, ["k"], order=["hot", "absent"], max_bytes=0).where("id = 0").first().k
    assert order == 0.0
    train, val = df.where("id < 2000"), df.where("id >= 2000")
    for more in ({}, {"max_bytes": 0}):
        a, b, k = mlprep.encode_target(train, val, "k", **more)
        assert k == train.select("k").distinct().count() - 1 and a.count() == 2000 and b.count() == 1000
        codes = {r.k for r in a.collect()}
        assert codes == {-1, *range(k)} and b.where("k >= 0").select("k").distinct().count() == 1  # only "hot" was seen


def test_no_task_gets_the_hot_key(spark):
    df = skewed(spark)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        counts = splitjoin.counted(df, F.col("k"))
        assert [r.value for r in splitjoin.frequent(counts, 100).collect()] == ["hot"]
        dictionary = counts.select("value", F.xxhash64("value").alias("code"))
        look = splitjoin.Lookup(dictionary, counts, max_bytes=0, share=100)
        out = look.join(df, F.col("k"))
        assert out.count() == 40_000 and out.where("code IS NULL").count() == 4000
        assert out.where("NOT code <=> xxhash64(c1) AND c1 IS NOT NULL").count() == 0
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 2 * median(sizes), sizes
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edges(spark):
    df = skewed(spark, 100)
    for empty in (df.limit(0), df.select("id", F.lit(None).cast("string").alias("k"))):
        assert encode.label_encoder(empty, ["k"], max_bytes=0).count() == empty.count()
        look = splitjoin.Lookup(df.limit(0).select(F.col("k").alias("value"), F.col("id").alias("code")), splitjoin.counted(df.limit(0), F.col("k")), max_bytes=-1)
        assert look.join(df, F.col("k")).where("code IS NULL").count() == 100
