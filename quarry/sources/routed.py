"""Delimited files with damaged rows: typed rows on one side, what fits no schema on the other.

``read_csv`` turns a cell that doesn't parse into NULL, and a short row into NULLs.  ``route_csv`` reads the
files once, as lines, parses each line against the schema and writes both outcomes in one Parquet table of
the shared folder (``spark.checkpoint.dir``); the two sides are reads of it.  A rejected line comes with its
file, its line number (from 1, headers and blank lines counted) and the first column that doesn't fit.

A line is rejected if it has more or fewer cells than the schema, or a cell that isn't empty and is no value
of its column's type.  Empty cells are NULL.  Blank lines are on neither side.  A record is one line, as in
Spark's own reader: a quoted line break makes two lines, each of them judged.

Line numbers: a scan's splits keep the order of their lines, so a line's number is the count of lines in the
splits before it in its file, and its place in its own.  Splits and places are written with the lines, so
later reads may be split differently.  The count is one row a split.  No rows are collected or shuffled but
those counts; a file of bad lines only costs what one of good lines does.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..plans.guards import bounded_broadcast, cut_lineage
from ..session import checkpoint_dir


@dataclass(frozen=True)
class Routed:
    """``good``: the schema's columns; ``bad``: file, line, raw, column (NULL: wrong number of cells); ``path``: the table of both."""

    good: DataFrame
    bad: DataFrame
    path: str


def _parsed(raw: Column, types: list[T.DataType], options: dict) -> Column:
    """The line as a struct ``c0, c1, ..., broken``; ``broken`` is the line itself where it doesn't fit."""
    fields = [T.StructField(f"c{i}", t) for i, t in enumerate(types)]
    ddl = T.StructType([*fields, T.StructField("broken", T.StringType())]).toDDL()
    return F.from_csv(raw, ddl, {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def route_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, header: bool = True, sep: str = ",",
              options: dict | None = None) -> Routed:
    """Read delimited files against ``schema``; see the module's text.  ``options``: further ones of Spark's CSV parser.

    With ``header`` the first line of each file is left out.  Files without lines give two empty tables."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parser = {"sep": sep, **(options or {})}
    types = [f.dataType for f in schema.fields]
    lines = spark.read.text(path).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"))
    both = lines.withColumn("row", _parsed(F.col("raw"), types, parser))
    blank, bad = F.trim("raw") == "", F.col("row.broken").isNotNull()
    # a rejected row keeps the cells that parsed: the first that is there as text and not as a value is at fault
    texts = _parsed(F.col("raw"), [T.StringType()] * len(types), parser)
    fault = F.coalesce(*[F.when(F.col(f"text.c{i}").isNotNull() & F.col(f"row.c{i}").isNull(), F.lit(n)) for i, n in enumerate(schema.names)])
    both = both.withColumn("text", F.when(~blank & bad, texts))
    target = os.path.join(checkpoint_dir(spark), "quarry-out", f"routed-{uuid.uuid4().hex[:12]}")
    both.select(
        "file", "split", "place", F.when(blank, "blank").when(bad, "bad").otherwise("good").alias("state"),
        F.when(~blank & bad, F.col("raw")).alias("raw"), F.when(F.col("text.broken").isNull(), fault).alias("column"),
        F.when(~blank & ~bad, F.col("row").dropFields("broken")).alias("row")).write.parquet(target)

    both = spark.read.parquet(target)
    splits = both.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = cut_lineage(splits.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before")))
    good, rejected = both.where("state = 'good'"), both.where("state = 'bad'")
    if header:
        heads = bounded_broadcast(splits.where("before = 0").select("file", F.col("first").alias("place")))
        good, rejected = (side.join(heads, ["file", "place"], "left_anti") for side in (good, rejected))
    rows = good.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(schema.names)])
    line = F.col("before") + F.col("place") - F.col("first") + 1
    rejected = rejected.join(bounded_broadcast(splits), ["file", "split"]).select("file", line.alias("line"), "raw", "column")
    return Routed(nan_to_null(rows), rejected, target)
