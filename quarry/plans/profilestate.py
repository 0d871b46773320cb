"""Profiles of tables that grow by parts: a stored state per part, merged without reading old rows again.

``add_part`` scans a part once and writes what exact answers need, under ``path``:

* ``values``: each column's distinct cells with their counts (missing cells as one row), with the interval
  of numeric ones, sorted by column and interval so that a scan for some intervals skips the rest;
* ``intervals``: count, smallest and largest value by column and interval;
* ``columns``: type, rows, missing cells, moments about the part's mean, zeros and negatives.  It is written
  last: a part without it was never finished, is not read, and is written anew on the next try.

Merging adds these up.  Means and moments are combined about the common mean, which is exact algebra and
independent of the order of the parts.  Exact quantiles place their ranks in the merged intervals and read
the values of the open ones only; outliers are counted from whole intervals and the two that a fence cuts.
Distinct counts, top values and histograms read the merged cells.  The state is at most as large as the
columns profiled (``cols``; leave out long texts that never repeat) and far smaller where values repeat.

Edge cases: NULL and NaN are missing.  An empty part counts no rows.  Repeated rows count.  A finished part
isn't written again unless ``replace`` is set.  Parts must agree in column names and types; otherwise
``add_part`` raises.  Column names are data here, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC, column_class, dtype_name, is_float, q
from .guards import cut_lineage
from .quantiles import LIMIT, _fine, _lerp_value, _values_at

CELL = ["key", "b", "v", "cell"]
COLUMNS = ("key int, col_name string, dtype string, col_class string, rows long, missing long, n long, mean double, m2 double, m3 double, "
           "m4 double, min double, max double, zeros long, negatives long")


def _cell(f: T.StructField, key: int) -> Column:
    """``key, v, cell`` of a column's cell: numbers as doubles (long and decimal ones as text beside it), others as text; both NULL: missing."""
    c, kind = q(f.name), f.dataType
    v, cell = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, T.NumericType):
        x = F.when(~F.isnan(c), c) if is_float(kind) else c
        v = x.cast("double") + F.lit(0.0)  # -0.0 is 0.0
        if isinstance(kind, (T.LongType, T.DecimalType)):  # doubles don't tell all of them apart
            cell = c.cast("string")
    elif isinstance(kind, T.TimestampType):
        cell = F.unix_micros(c).cast("string")  # whatever the session's time zone
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        cell = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("c"))))
    elif isinstance(kind, T.BinaryType):
        cell = F.hex(c)
    else:
        cell = c.cast("string")
    return F.struct(F.lit(key).alias("key"), v.alias("v"), cell.alias("cell"))


def _read(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """A table of all finished parts."""
    try:
        done = spark.read.schema(COLUMNS + ", part string").parquet(f"{path}/columns")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if table == "columns":
        return done
    parts = sorted(r["part"] for r in done.select("part").distinct().collect())
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/part={p}" for p in parts])
    return rows.drop("part")


def add_part(df: DataFrame, path: str, part: str, cols: Sequence[str] | None = None, replace: bool = False) -> None:
    """Profile ``df`` as the part ``part`` (letters, digits, - and _) of the state under ``path``."""
    if not part or not all(c.isascii() and (c.isalnum() or c in "-_") for c in part):
        raise ValueError(f"a part's name has letters, digits, - and _ only: {part!r}")
    spark = df.sparkSession
    df = df.select(*[q(c) for c in (df.columns if cols is None else cols)])
    fields = df.schema.fields
    shape = [(i, f.name, dtype_name(f.dataType), column_class(f.dataType)) for i, f in enumerate(fields)]
    done = _read(spark, path, "columns")
    if done is not None:
        if not replace and not done.where(F.col("part") == part).isEmpty():
            raise ValueError(f"part {part!r} is there already")
        known = done.where(F.col("part") != part).select("key", "col_name", "dtype", "col_class").distinct().orderBy("key").collect()
        if known and [tuple(r) for r in known] != shape:
            raise ValueError(f"part {part!r} has other columns or types than the parts before: {shape}")
        if replace:  # from here on the part is unfinished
            spark.createDataFrame([], COLUMNS).write.mode("overwrite").parquet(f"{path}/columns/part={part}")
    cells = df.select(F.inline(F.array(*[_cell(f, i) for i, f in enumerate(fields)]))).withColumn("b", _fine(F.col("v")))
    counted = cells.groupBy(*CELL).agg(F.count("*").alias("c"))
    counted.sortWithinPartitions("key", "b", "v").write.mode("overwrite").parquet(f"{path}/values/part={part}")
    values = spark.read.schema("key int, b int, v double, cell string, c long").parquet(f"{path}/values/part={part}")
    numbers = values.where("v IS NOT NULL")
    runs = numbers.groupBy("key", "b").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    runs.write.mode("overwrite").parquet(f"{path}/intervals/part={part}")
    meta = spark.createDataFrame(shape, "key int, col_name string, dtype string, col_class string")
    missing = F.sum(F.when(F.col("v").isNull() & F.col("cell").isNull(), F.col("c")).otherwise(0))
    sizes = values.groupBy("key").agg(F.sum("c").alias("rows"), missing.alias("missing"))
    means = numbers.groupBy("key").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    d, c = F.col("v") - F.col("mean"), F.col("c")
    moments = numbers.join(F.broadcast(means), "key").groupBy("key", "n", "mean").agg(  # one row a column
        *[F.sum(F.pow(d, F.lit(float(k))) * c).alias(f"m{k}") for k in (2, 3, 4)], F.min("v").alias("min"), F.max("v").alias("max"),
        F.sum(F.when(F.col("v") == 0, c).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("v") < 0, c).otherwise(0)).alias("negatives"))
    out = meta.join(sizes, "key", "left").join(moments, "key", "left").fillna(0, ["rows", "missing", "n", "zeros", "negatives"])
    out.select(*[F.col(f.name) for f in T.StructType.fromDDL(COLUMNS)]).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns/part={part}")  # a row a column


def _table(spark: SparkSession, path: str, table: str) -> DataFrame:
    rows = _read(spark, path, table)
    if rows is None:
        raise ValueError(f"no finished part under {path}")
    return rows


def merged_columns(spark: SparkSession, path: str) -> DataFrame:
    """A row a column: ``key, col_name, dtype, col_class, rows, missing, n, mean, m2, m3, m4, min, max, zeros, negatives`` of all parts."""
    parts = _table(spark, path, "columns")
    name = ["key", "col_name", "dtype", "col_class"]
    mean = F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n"))
    sums = [F.sum(c).alias(c) for c in ("rows", "missing", "n", "zeros", "negatives")]
    whole = parts.groupBy(*name).agg(*sums, mean.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    # moments of a part about the common mean, d away from its own
    d, n, m2, m3, m4 = F.col("mean") - F.col("at"), F.col("n"), F.col("m2"), F.col("m3"), F.col("m4")
    moved = parts.join(whole.select("key", F.col("mean").alias("at")), "key").groupBy("key").agg(
        F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"))
    return whole.join(moved, "key")


def merged_cells(spark: SparkSession, path: str) -> DataFrame:
    """``key, b, v, cell, c``: the distinct cells of all parts with their counts."""
    return _table(spark, path, "values").groupBy(*CELL).agg(F.sum("c").alias("c"))


def merged_intervals(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "intervals").groupBy("key", "b").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def numeric_keys(spark: SparkSession, path: str) -> dict[str, int]:
    """The numeric columns and their places, in the table's order."""
    rows = _table(spark, path, "columns").where(F.col("col_class") == NUMERIC).select("key", "col_name").distinct().orderBy("key").collect()
    return {r["col_name"]: r["key"] for r in rows}


def merged_quantiles(spark: SparkSession, path: str, probs: Sequence[float], limit: int = LIMIT, runs: DataFrame | None = None) -> dict[str, list]:
    """{numeric column: [q(p) for p in probs]} of all parts, exactly; None without values.

    Only values of intervals that hold a target rank are read, found by their interval."""
    keys = numeric_keys(spark, path)
    names = {k: c for c, k in keys.items()}
    runs = cut_lineage(merged_intervals(spark, path)) if runs is None else runs
    n = {names[r["key"]]: r["n"] for r in runs.groupBy("key").agg(F.sum("c").alias("n")).collect()}
    at = {c: [(math.floor((n[c] - 1) * p), (n[c] - 1) * p) for p in probs] for c in keys if c in n}
    ranks = {c: sorted({x for r, _ in places for x in (r, min(r + 1, n[c] - 1))}) for c, places in at.items()}
    if not ranks:
        return {c: [None] * len(probs) for c in keys}
    order = {c: i for i, c in enumerate(ranks)}
    place = F.element_at(F.create_map(*[F.lit(x) for c in ranks for x in (keys[c], order[c])]), F.col("key"))
    values = _table(spark, path, "values")

    def inside(open_: dict[str, list[tuple]]) -> DataFrame:
        asked = [(keys[c], at, float(lo), float(hi)) for c, of in open_.items() for at, (lo, hi) in enumerate(of)]
        asked = spark.createDataFrame(asked, "key int, at int, lo double, hi double").withColumn("b", _fine(F.col("lo")))
        some = values.where(F.col("b").isin(sorted({r["b"] for r in asked.select("b").collect()})))
        both = some.join(F.broadcast(asked), ["key", "b"])  # columns x ranks
        return both.where("v >= lo AND v <= hi").select(place.alias("key"), "at", "lo", "hi", "v", "c")

    found = _values_at(inside, ranks, runs.withColumn("key", place), limit, F.sum("c"))
    out: dict[str, list] = {c: [None] * len(probs) for c in keys}
    for c, places in at.items():
        out[c] = [_lerp_value(found[c][r], found[c][min(r + 1, n[c] - 1)], h - r) for r, h in places]
    return out


def merged_outside(spark: SparkSession, path: str, fences: dict[str, tuple[float, float]], runs: DataFrame) -> DataFrame:
    """(key, outside): values of all parts below or above their column's fences."""
    keys = numeric_keys(spark, path)
    bounds = F.broadcast(spark.createDataFrame([(keys[c], float(a), float(b)) for c, (a, b) in fences.items()], "key int, f0 double, f1 double"))
    runs = runs.join(bounds, "key")
    whole = (F.col("hi") < F.col("f0")) | (F.col("lo") > F.col("f1"))
    cut = runs.where(~whole & ((F.col("lo") < F.col("f0")) | (F.col("hi") > F.col("f1")))).select("key", "b", "f0", "f1")
    rows = _table(spark, path, "values").join(F.broadcast(cut), ["key", "b"])  # at most two intervals a column
    outer = rows.where("v < f0 OR v > f1").select("key", "c").unionByName(runs.where(whole).select("key", "c"))
    return outer.groupBy("key").agg(F.sum("c").alias("outside"))
