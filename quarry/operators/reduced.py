"""Chart data of a bounded size that keeps the shape of all points.

``charts.chart_line`` and ``charts.chart_scatter`` return every point.  Here the whole table is read too, but
the result depends on the resolution asked for:

* ``chart_line_reduced``: largest triangle of three buckets.  A trace is cut into ``points`` intervals of equal
  width along x; from each the point is kept that spans the largest triangle with the means of its two
  neighbours, so spikes and turns stay.  Intervals without points are passed over.  The first, last, lowest and
  highest point of each trace are always kept.
* ``chart_scatter_cells``: a quadtree of counts.  A square of more than ``leaf`` points is cut in four, down to
  ``depth`` levels; every point is counted in one cell.

Rows without x or y (NULL or NaN) are no points.  Ties: of equal triangles the point of the largest x, then y;
of equal extremes see ``chart_line_reduced``.  Equal points count once in a line, each in cells.  Empty tables
give empty results.  x may be a number, a date or a time, y a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DATETIME, NUMERIC, column_class, is_float, q
from ..plans.guards import cut_lineage
from ..plans.splitjoin import Lookup
from .charts import _shown


def _units(c: Column, dt: T.DataType) -> Column:
    """Where a value lies on its axis: numbers as they are, dates as days, times as microseconds."""
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long")
    return F.unix_micros(c.cast("timestamp")) if column_class(dt) == DATETIME else c.cast("double")


def _points(df: DataFrame, x: str, y: str, *more: Column) -> DataFrame:
    for name, kinds in ((x, (NUMERIC, DATETIME)), (y, (NUMERIC,))):
        if column_class(df.schema[name].dataType) not in kinds:
            raise ValueError(f"{name}: not a {' or '.join(kinds)} column")
    rows = df.select(*more, q(x).alias("x"), q(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    for c in ("x", "y"):
        if is_float(rows.schema[c].dataType):
            rows = rows.where(~F.isnan(c))
    return rows


def _slice(offset: Column, width: Column, parts: int) -> Column:
    """Which of ``parts`` equal slices of ``width`` an offset falls into (the last one closed)."""
    return F.when(width > 0, F.least(F.floor(offset * F.lit(float(parts)) / width).cast("int"), F.lit(parts - 1))).otherwise(0)


def chart_line_reduced(df: DataFrame, x: str, y: str, color: str | None = None, points: int = 1000) -> DataFrame:
    """At most ``points`` + 4 points a trace, in the order of (color, x).

    Three scans with map-side aggregates: the traces' ranges, the means of the intervals, the best point of each.
    Ranges and means (``points`` rows a trace) are joined to the points as dictionaries, with frequent intervals
    apart beyond the broadcast bound; windows run over the means of a trace only.  First and last are the lowest of
    the smallest x and the highest of the largest; low and high the first of the smallest y and the last of the largest."""
    rows = _points(df, x, y, F.struct((q(color) if color else F.lit(0)).alias("trace")).alias("key"))
    kind = rows.schema["x"].dataType
    frame = cut_lineage(rows.groupBy(F.col("key").alias("value")).agg(
        F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"), F.count("*").alias("n")))
    ranges = Lookup(frame.drop("n"), frame.select("value", "n")).join(rows, F.col("key")).withColumnsRenamed({"c0": "key", "c1": "x", "c2": "y"})
    at = (_units(F.col("x"), kind) - _units(F.col("x_lo"), kind)).cast("double")
    width = (_units(F.col("x_hi"), kind) - _units(F.col("x_lo"), kind)).cast("double")
    placed = ranges.withColumn("at", at).withColumn("width", width).withColumn("value", F.struct("key.trace", _slice(F.col("at"), F.col("width"), points).alias("slice")))

    v = F.col("y").cast("double")
    means = cut_lineage(placed.groupBy("value").agg(
        F.avg("at").alias("mx"), F.avg(v).alias("my"), F.count("*").alias("n"), F.max("width").alias("width"),
        *[F.max(c).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")],
        F.min(F.when(F.col("x") == F.col("x_lo"), F.col("y"))).alias("first_y"), F.max(F.when(F.col("x") == F.col("x_hi"), F.col("y"))).alias("last_y"),
        F.min(F.when(F.col("y") == F.col("y_lo"), F.col("x"))).alias("low_x"), F.max(F.when(F.col("y") == F.col("y_hi"), F.col("x"))).alias("high_x")))
    ends = means.groupBy(F.col("value.trace").alias("trace")).agg(
        *[F.min(c).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi", "first_y", "low_x")], F.max("last_y").alias("last_y"), F.max("high_x").alias("high_x"))
    corners = ends.select("trace", F.inline(F.array(*[
        F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("x_lo", "first_y"), ("x_hi", "last_y"), ("low_x", "y_lo"), ("high_x", "y_hi"))])))

    along = Window.partitionBy("value.trace").orderBy("value.slice")
    whole = Window.partitionBy("value.trace")
    beside = means.select(
        "value", F.lag("mx", 1, 0.0).over(along).alias("px"), F.coalesce(F.lag("my").over(along), F.min("first_y").over(whole).cast("double")).alias("py"),
        F.coalesce(F.lead("mx").over(along), F.col("width")).alias("nx"), F.coalesce(F.lead("my").over(along), F.max("last_y").over(whole).cast("double")).alias("ny"))
    near = Lookup(beside, means.select("value", "n")).join(placed.select("value", "x", "y", "at"), F.col("value")).withColumnsRenamed(
        {"c0": "value", "c1": "x", "c2": "y", "c3": "at"})
    area = F.abs((F.col("px") - F.col("nx")) * (v - F.col("py")) - (F.col("px") - F.col("at")) * (F.col("ny") - F.col("py")))
    best = near.groupBy("value").agg(F.max(F.struct(area.alias("area"), "x", "y")).alias("top")).select("value.trace", "top.x", "top.y")
    out = best.unionByName(corners).distinct().orderBy("trace", "x", "y")
    x_name, y_name, *trace_name = _shown([x, y, *([color] if color else [])])
    return out.select(*[F.col("trace").alias(n) for n in trace_name], F.col("x").alias(x_name), F.col("y").alias(y_name))


def chart_scatter_cells(df: DataFrame, x: str, y: str, leaf: int = 1000, depth: int = 8) -> DataFrame:
    """``level, x_from, x_to, y_from, y_to, count``: the quadtree's leaves that hold points, on axes of numbers, days or microseconds.

    The points are counted in the finest grid (at most 4 ** ``depth`` groups, map-side); all levels come from those counts."""
    rows = _points(df, x, y)
    rows = rows.select(*[_units(F.col(c), rows.schema[c].dataType).cast("double").alias(c) for c in ("x", "y")])
    lo = rows.agg(*[f(c).alias(n + c) for c in ("x", "y") for f, n in ((F.min, "lo_"), (F.max, "hi_"))]).first()  # one row
    span = {c: (lo["lo_" + c] or 0.0, (lo["hi_" + c] or 0.0) - (lo["lo_" + c] or 0.0)) for c in ("x", "y")}
    finest = rows.groupBy(*[_slice(F.col(c) - span[c][0], F.lit(span[c][1]), 1 << depth).alias("i" + c) for c in ("x", "y")]).count()
    levels = finest.select("ix", "iy", "count", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    shift = [F.call_function("shiftright", F.col(i), F.lit(depth) - F.col("level")).alias(i) for i in ("ix", "iy")]
    cells = cut_lineage(levels.select("level", *shift, "count").groupBy("level", "ix", "iy").agg(F.sum("count").alias("count")))
    cut = cells.where((F.col("count") > leaf) & (F.col("level") < depth)).select((F.col("level") + 1).alias("l"), F.col("ix").alias("px"), F.col("iy").alias("py"))
    below = (F.col("l") == F.col("level")) & (F.col("px") == F.shiftright("ix", 1)) & (F.col("py") == F.shiftright("iy", 1))
    leaves = cells.where((F.col("count") <= leaf) | (F.col("level") == depth))
    shown = leaves.where("level = 0").unionByName(leaves.join(cut, below, "left_semi"))
    side = F.pow(F.lit(2.0), F.col("level"))
    edges = [F.round(F.lit(span[c][0]) + (F.col("i" + c) + k) * F.lit(span[c][1]) / side, 6).alias(f"{c}_{n}") for c in ("x", "y") for k, n in ((0, "from"), (1, "to"))]
    return shown.select("level", *edges, "count")
