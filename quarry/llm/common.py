"""Helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_SHIPPED: set[str] = set()


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` is its DuckDB equivalent where SQL can express it."""

    def deco(fn):
        @functools.wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, unless PYTHONPATH or the folder already does."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, sc = os.path.dirname(package), spark.sparkContext
    if root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) or sc.applicationId in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quarry-package-"), "quarry.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder in (package, os.path.dirname(os.path.abspath(__file__))):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Unset, a local session (one process, as in tests) gets a temporary folder; a cluster raises."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-llm-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage without depending on any executor's disk, and later readers prune columns."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint for a side whose measured row count (fixed-width rows) is within the bound."""
    return F.broadcast(df) if rows <= max_rows else df


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
