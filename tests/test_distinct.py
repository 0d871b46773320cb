"""Exact distinct counts: every type against plain counts, forced collisions, and how little moves."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.operators import profile
from quarry.plans import distinct
from quarry.queries.tables import table

from .conftest import SF

NAN, INF = float("nan"), float("inf")
DAY, TIME = dt.date(1950, 1, 2), dt.datetime(2020, 3, 4)
SCHEMA = "`a.b` long, slot int, number double, f float, at date, t timestamp, n timestamp_ntz, word boolean, there string, lo binary, d decimal(12,2), w decimal(38,5), l array<int>"
ROWS = [
    (1, 1, 0.0, 0.5, DAY, TIME, TIME, True, "a", b"a", Decimal("1.10"), Decimal("1.1"), [1]),
    (1, -1, -0.0, 0.1, DAY, TIME + dt.timedelta(microseconds=1), TIME, False, "", b"", Decimal("1.1"), Decimal("1e20"), [1, 2]),
    (-1, 63, NAN, 0.5, dt.date(1, 1, 1), TIME + dt.timedelta(days=1), TIME + dt.timedelta(seconds=5), None, "a ", b"a", None, None, None),
    (2**63 - 1, 64, NAN, NAN, dt.date(9999, 12, 31), None, None, True, None, None, Decimal("-1.1"), Decimal("-1e20"), []),
    (-(2**63), 65, INF, INF, None, TIME, TIME + dt.timedelta(days=1), True, "x" * 100_000, b"\x00", Decimal("0"), Decimal("0"), [1]),
    (0, -64, -INF, -0.0, DAY, TIME, TIME, None, "x" * 100_000 + "y", b"\x00\x00", Decimal("0"), Decimal("0"), [None]),
    (None, None, 1e300, 0.0, DAY, TIME, TIME, None, "a", b"a", Decimal("0"), Decimal("0"), [1]),
    (None, None, 0.07, 1e-30, DAY, TIME, TIME, None, "A", b"a", Decimal("0"), Decimal("0"), [1]),
    (None, None, math.nextafter(0.07, 1), 1e-30, DAY, TIME, TIME, None, "A", b"a", Decimal("0"), Decimal("0"), [1]),
]


def few(cell):
    return F.pmod(F.xxhash64(cell), F.lit(2)).cast("long"), F.xxhash64(F.lit(1), cell)


@pytest.mark.parametrize("hashes", [distinct.two_hashes, few])
def test_every_type(spark, hashes):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = distinct.distinct_counts(df, df.columns, hashes)
    q = distinct.q
    plain = df.select(*[F.count_distinct(q(c) + F.lit(0.0) if c in ("number", "f") else q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    assert list(got.values()) == list(plain)
    assert distinct.distinct_counts(df.limit(0), df.columns, hashes) == dict.fromkeys(df.columns, 0)


@pytest.mark.parametrize("name", ["lineitem", "events", "documents"])
def test_whole_tables(spark, name):
    df = table(spark, SF, name)
    plain = df.select(*[F.count_distinct(distinct.q(c)).alias(c) for c in df.columns]).first().asDict()
    assert {r.col_name: r.unique_count for r in profile.column_unique_counts(df).collect()} == plain


def test_random_doubles(spark):
    df = spark.range(20_000).select((F.rand(1) * 10 ** (F.col("id") % 40 - 20)).alias("x"), F.round(F.rand(2) * 1000, 2).alias("y"), (F.rint(F.rand(3) * 1e6) / 100 * F.lit(1.1)).alias("z"))
    plain = df.select(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    assert distinct.distinct_counts(df, df.columns) == plain


def test_neighbours_share_rows(spark):
    """A dense column of n values makes n / 64 words."""
    df = spark.range(0, 64_000, 1, 4).select(F.col("id"), (F.col("id") / 100.0).alias("cents"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"))
    assert set(distinct.distinct_counts(df, df.columns).values()) == {64_000}
    assert distinct.words(df, df.columns).count() <= 3 * 64_000 / 64 + 3
