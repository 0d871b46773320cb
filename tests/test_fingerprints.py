"""Equal rows by fingerprints: exact with forced collisions, and only repeated rows move."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import profile, rows
from quarry.plans import fingerprints

NAN = float("nan")
ROWS = [(1, "a", None, 0.0), (1, "a", None, -0.0), (1, None, "a", 0.0), (2, "b", "c", NAN), (2, "b", "c", NAN), (2, "b", "c", None), (3, "", "", 1.0), (3, "", None, 1.0),
        (4, "x" * 100_000, "y", 2.0), (4, "x" * 100_000, "y", 2.0), (4, "x" * 100_000, "z", 2.0), (None, None, None, None), (None, None, None, None)]


def few_bits(df, cols):
    return F.struct(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(2)).alias("a"))


def no_bits(df, cols):
    return F.struct(F.lit(0).alias("a"))


@pytest.mark.parametrize("mark", [fingerprints.fingerprint, few_bits, no_bits])
def test_exact_with_any_fingerprint(spark, mark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "`i.d` long, n long, fingerprint string, first string, v double")
    body = df.drop("i.d")
    if mark is few_bits:  # equal rows must keep equal bits: -0.0 and 0.0 hash apart here
        body = body.withColumn("v", F.col("v") + 0.0)
    plain = body.dropDuplicates()
    key = lambda r: tuple("nan" if x != x else x for x in r)
    assert Counter(map(key, rows.drop_duplicates_all(body, mark).collect())) == Counter(map(key, plain.collect()))
    beyond = len(ROWS) - plain.count()
    assert profile.duplicate_rows(body, mark).first()[:] == (beyond, round(beyond / len(ROWS) * 100, 2))
    for cols in (["n"], ["fingerprint", "first"], ["n", "first"]):
        kept = rows.drop_duplicates_subset(df, cols, order_by=["i.d"], mark=mark)
        seen, want = set(), []
        for i, r in enumerate(ROWS):
            k = tuple(dict(zip(("n", "fingerprint", "first", "v"), r))[c] for c in cols)
            want += [] if k in seen else [i]
            seen.add(k)
        assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == want
        assert rows.drop_duplicates_subset(df, cols, mark=mark).count() == len(want)
    assert rows.drop_duplicates_all(body.limit(0), mark).count() == 0 and profile.duplicate_rows(body.limit(0), mark).first()[:] == (0, 0.0)


def test_rows_without_duplicates_do_not_move(spark):
    wide = spark.range(5000).select("id", *[F.concat(F.lit("x" * 200), F.col("id"), F.lit(k)).alias(f"s{k}") for k in range(5)])
    once, several = fingerprints.parted(wide, wide.columns)
    assert (once.count(), several.count()) == (5000, 0)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert not fingerprints.worth_it(spark.range(3)) and fingerprints.worth_it(wide)
