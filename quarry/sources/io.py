"""Sources and sinks: files, JDBC queries, SQL over loaded tables, previews, CSV sinks."""

from __future__ import annotations

import itertools
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, q

FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "orc": "orc"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV; types inferred unless a schema is given (give one at scale: inference is an extra pass)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_table(spark: SparkSession, path: str, format: str | None = None, schema=None) -> DataFrame:
    """Dispatch on the lower-cased extension (or ``format``); unsupported formats and missing paths raise."""
    fmt = (format or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported file format: {fmt or '(none)'}")
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    fmt = FORMATS[fmt]
    if fmt == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def read_jdbc_query(spark: SparkSession, url: str, query: str, props: Mapping[str, str] | None = None,
                    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Run ``query`` in the database and load its result.

    Large loads must be split: with ``partition_column`` / bounds / ``num_partitions``
    Spark issues one range query per partition instead of one cursor."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in (props or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", num_partitions))
    else:
        reader = reader.option("query", query)
    return nan_to_null(reader.load())


def postgres_url(host: str, port: int, database: str) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def dedupe_names(names: list[str]) -> list[str]:
    """A name's first column keeps it; each later one gets the first free of ``name.1``, ``name.2`` ..."""
    taken, given = set(names), set()
    out: list[str] = []
    for name in names:
        if name in given:
            name = next(f"{name}.{k}" for k in itertools.count(1) if f"{name}.{k}" not in taken)
            taken.add(name)
        given.add(name)
        out.append(name)
    return out


def sql_query(spark: SparkSession, query: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """SQL over loaded tables (registered as temp views); duplicate output names are made unique."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    res = spark.sql(query)
    names = dedupe_names(res.columns)
    return res.toDF(*names) if names != res.columns else res


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First n rows (of ``order_by`` when given: a bounded top-n)."""
    return (df.orderBy(*[q(c) for c in order_by]) if order_by else df).limit(n)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_split_csv(split_df: DataFrame, out_dir: str, features: list[str], target: str, key: list[str] | None = None) -> dict:
    """Write X_train, y_train, X_val, y_val (one folder each) from a DataFrame with a ``split`` column.

    Files of a folder have no order, so every row carries ``key`` (or a ``row_id``) in both X and y.
    The split is computed once."""
    from ..functions.columns import numeric_columns
    from ..plans.guards import cut_lineage

    feats = numeric_columns(split_df, [c for c in features if c != target and c not in (key or [])])
    if key is None:
        key, split_df = ["row_id"], split_df.withColumn("row_id", F.monotonically_increasing_id())
    once = cut_lineage(split_df.select(*[q(c) for c in dict.fromkeys([*key, *feats, target, "split"])]))
    paths = {}
    for part in ("train", "val"):
        side = once.where(q("split") == part)
        for name, cols in (("X", feats), ("y", [target])):
            paths[f"{name}_{part}"] = write_csv(side.select(*[q(c) for c in [*key, *cols]]), os.path.join(out_dir, f"{name}_{part}"))
    return paths


def write_history_csv(history: DataFrame, path: str) -> str:
    return write_csv(history, path)
