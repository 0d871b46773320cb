"""Reduced charts against plain loops, with ties, NULLs, one point, clashing names, forced shuffle look-ups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators import reduced
from quarry.plans import splitjoin

rnd = random.Random(5)


def plain_line(rows, points):
    """The same choice, point by point: rows of (trace, x, y)."""
    out = set()
    traces = defaultdict(list)
    for t, x, y in rows:
        if x is not None and y is not None and x == x and y == y:
            traces[t].append((x, y))
    for t, pts in traces.items():
        x_lo, x_hi = min(pts)[0], max(pts)[0]
        w = float(x_hi - x_lo)
        buckets = defaultdict(list)
        for x, y in pts:
            buckets[min(int((x - x_lo) * float(points) / w), points - 1) if w else 0].append((x, y))
        first, last = min(pts), max(pts)
        low, high = min(pts, key=lambda p: (p[1], p[0])), max(pts, key=lambda p: (p[1], p[0]))
        means = [(sum(x - x_lo for x, _ in buckets[b]) / len(buckets[b]), sum(y for _, y in buckets[b]) / len(buckets[b])) for b in sorted(buckets)]
        means = [(0.0, first[1]), *means, (w, last[1])]
        for k, b in enumerate(sorted(buckets)):
            (px, py), (nx, ny) = means[k], means[k + 2]
            top = max(buckets[b], key=lambda p: (abs((px - nx) * (p[1] - py) - (px - (p[0] - x_lo)) * (ny - py)), p))
            out.add((t, *top))
        out |= {(t, *p) for p in (first, last, low, high)}
    return out


def grid_rows():
    """Halves and few of them a bucket in eighths: means are exact, so ties are real ties."""
    rows = [(rnd.choice(["a", "b", None]), float(rnd.randrange(0, 64)), float(rnd.randrange(-8, 8))) for _ in range(64)]
    return rows + rows[:9] + [("c", 5.0, 1.0), ("a", None, 1.0), ("a", 1.0, None), ("b", 1.0, float("nan")), ("d", None, None)]


@pytest.mark.parametrize("bound", [splitjoin.BROADCAST_BYTES, 0])
def test_line_as_plain_loops(spark, monkeypatch, bound):
    init = splitjoin.Lookup.__init__
    monkeypatch.setattr(splitjoin.Lookup, "__init__", lambda self, d, c: init(self, d, c, max_bytes=bound, share=8))
    rows = grid_rows()
    df = spark.createDataFrame(rows, "key string, value double, at double")
    got = [tuple(r) for r in reduced.chart_line_reduced(df, "value", "at", "key", points=7).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_line(rows, 7)
    assert len(got) <= 4 * (7 + 4)


def test_line_of_many_points_keeps_spikes(spark):
    df = spark.range(0, 50_000, 1, 4).select(F.col("id").alias("x"), F.when(F.col("id") == 31_234, 1e6).when(F.col("id") == 777, -1e6).otherwise(F.sin(F.col("id") / 900)).alias("y"))
    got = [tuple(r) for r in reduced.chart_line_reduced(df, "x", "y", points=100).collect()]
    assert {31_234, 777, 0, 49_999} <= {x for x, _ in got} and 100 <= len(got) <= 104
    assert got == sorted(got)


def test_line_times_days_and_errors(spark):
    df = spark.sql("SELECT date_add(DATE'2020-01-01', cast(id as int)) AS x, timestampadd(SECOND, id, TIMESTAMP_NTZ'2020-01-01 00:00:00') AS t, cast(id % 3 as int) AS y, 'z' AS s FROM range(50)")
    for c in ("x", "t"):
        assert reduced.chart_line_reduced(df, c, "y", points=5).schema[c].dataType == df.schema[c].dataType
        assert 5 <= reduced.chart_line_reduced(df, c, "y", points=5).count() <= 9
    assert reduced.chart_line_reduced(df.limit(0), "x", "y", "s").count() == 0
    names = reduced.chart_line_reduced(df, "y", "y", "y").columns
    assert len(names) == len(set(names)) == 3
    with pytest.raises(ValueError):
        reduced.chart_line_reduced(df, "s", "y")


def plain_cells(pts, leaf, depth):
    lo = [min(p[k] for p in pts) for k in (0, 1)]
    w = [max(p[k] for p in pts) - lo[k] for k in (0, 1)]
    at = [tuple(min(int((p[k] - lo[k]) * 2**depth / w[k]), 2**depth - 1) if w[k] else 0 for k in (0, 1)) for p in pts]

    def descend(level, cell, mine):
        if not mine:
            return
        if len(mine) <= leaf or level == depth:
            yield level, *cell, len(mine)
            return
        for dx in (0, 1):
            for dy in (0, 1):
                c = (2 * cell[0] + dx, 2 * cell[1] + dy)
                yield from descend(level + 1, c, [a for a in mine if (a[0] >> depth - level - 1, a[1] >> depth - level - 1) == c])

    return sorted((lv, round(lo[0] + x * w[0] / 2**lv, 6), round(lo[1] + y * w[1] / 2**lv, 6), n) for lv, x, y, n in descend(0, (0, 0), at))


@pytest.mark.parametrize("leaf, depth", [(1, 4), (5, 3), (1000, 4), (0, 2)])
def test_cells_as_recursion(spark, leaf, depth):
    pts = [(rnd.gauss(0, 1), rnd.choice([0.0, 0.0, rnd.random()])) for _ in range(150)] + [(0.5, 0.5)] * 40
    df = spark.createDataFrame([*pts, (None, 1.0), (1.0, None), (float("nan"), 1.0)], "level double, count double")
    got = reduced.chart_scatter_cells(df, "level", "count", leaf, depth).collect()
    assert sorted((r["level"], r["x_from"], r["y_from"], r["count"]) for r in got) == plain_cells(pts, leaf, depth)
    assert sum(r["count"] for r in got) == len(pts)


def test_cells_of_one_place_and_none(spark):
    df = spark.createDataFrame([(1, 2.0)] * 9, "x int, y double")
    assert [tuple(r) for r in reduced.chart_scatter_cells(df, "x", "y", 3, 2).collect()] == [(2, 1.0, 1.0, 2.0, 2.0, 9)]
    assert reduced.chart_scatter_cells(df.limit(0), "x", "y").count() == 0
