"""Registered source / sink queries with oracles.

Sink queries write under the session's checkpoint folder (``spark.checkpoint.dir``,
a shared folder on a cluster) and read the files back.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import mlprep as M
from ..plans.ordered import page as page_op
from ..session import checkpoint_dir
from ..sources import io as IO
from ..sources.routed import route_csv
from .ml_q import HISTORY_SQL, event_history
from .registry import register
from .tables import table


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), "quarry-out", f"{name}-{uuid.uuid4().hex[:12]}")


@register("read_parquet", "SELECT * FROM lineitem")
def read_parquet(spark, sf):
    table(spark, sf, "region")  # session defaults
    return IO.read_parquet(spark, f"{sf}/lineitem.parquet")


@register("read_table", "SELECT * FROM customer")
def read_table(spark, sf):
    table(spark, sf, "region")
    return IO.read_table(spark, f"{sf}/customer.parquet")


@register("read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def read_csv(spark, sf):
    src = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = IO.write_csv(src, _scratch(spark, "orders-csv"))
    back = IO.read_csv(spark, path, schema=src.schema)
    return back


# A line an order; some have a key with a letter, a price that is no number, a cell too few or too many, or no status.
_DAMAGED = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR(30)) AS price, "
    "CASE WHEN o_orderkey % 13 = 0 THEN 'key' WHEN o_orderkey % 7 = 0 THEN 'price' WHEN o_orderkey % 11 = 0 THEN 'short' "
    "WHEN o_orderkey % 17 = 0 THEN 'long' WHEN o_orderkey % 5 = 0 THEN 'empty' ELSE 'none' END AS damage FROM orders")
_DAMAGED_LINES = (
    "SELECT *, concat(CASE WHEN damage = 'key' THEN 'x' ELSE '' END, CAST(o_orderkey AS VARCHAR(30)), ',', CAST(o_custkey AS VARCHAR(30)), "
    "CASE WHEN damage = 'short' THEN '' ELSE concat(',', CASE WHEN damage = 'empty' THEN '' ELSE o_orderstatus END) END, ',', price, "
    "CASE WHEN damage = 'price' THEN ' EUR' WHEN damage = 'long' THEN ',1' ELSE '' END) AS raw FROM d")


@register("read_csv_routed",
          f"WITH d AS ({_DAMAGED}), l AS ({_DAMAGED_LINES}) SELECT CASE WHEN damage IN ('none', 'empty') THEN 'good' ELSE 'bad' END AS side, "
          "CASE WHEN damage IN ('none', 'empty') THEN o_orderkey END AS o_orderkey, CASE WHEN damage IN ('none', 'empty') THEN o_custkey END AS o_custkey, "
          "CASE WHEN damage = 'none' THEN o_orderstatus END AS o_orderstatus, CASE WHEN damage IN ('none', 'empty') THEN CAST(price AS DOUBLE) END AS o_totalprice, "
          "CASE WHEN damage NOT IN ('none', 'empty') THEN raw END AS raw, "
          "CASE WHEN damage = 'key' THEN 'o_orderkey' WHEN damage = 'price' THEN 'o_totalprice' END AS fault FROM l")
def read_csv_routed(spark, sf):
    """Every order as a line, some of them damaged; typed rows and rejected lines together (line numbers: see the tests)."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    lines = spark.sql(f"WITH d AS ({_DAMAGED}) {_DAMAGED_LINES}").select(F.col("raw").alias("value"))
    path = _scratch(spark, "damaged")
    lines.write.text(path)
    found = route_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", header=False)
    good = found.good.select(F.lit("good").alias("side"), "*", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("fault"))
    bad = found.bad.select(F.lit("bad").alias("side"), "raw", F.col("column").alias("fault"))
    return good.unionByName(bad, allowMissingColumns=True)


@register("sql_query", "SELECT o_orderkey, o_custkey AS k, o_totalprice AS \"k.1\", o_orderstatus AS \"k.2\" FROM orders")
def sql_query(spark, sf):
    o = table(spark, sf, "orders")
    return IO.sql_query(spark, "SELECT o_orderkey, o_custkey AS k, o_totalprice AS k, o_orderstatus AS k FROM o", {"o": o})


@register("page",
          "SELECT o_orderkey, o_custkey, o_totalprice, row_number AS row_number, total_rows, total_pages FROM "
          "(SELECT o_orderkey, o_custkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS row_number, "
          "CAST(count(*) OVER () AS BIGINT) AS total_rows, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS total_pages FROM orders) "
          "WHERE row_number > 20 AND row_number <= 30")
def page(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return page_op(df, 3, 10, ["o_orderkey"])


@register("preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(spark, sf):
    return IO.preview(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 10, ["o_orderkey"])


@register("write_split_csv",
          "WITH s AS (SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= "
          "CAST(floor(count(*) OVER () * (1 - 0.2)) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM orders) "
          "SELECT o_orderkey, o_totalprice, o_orderstatus, split FROM s")
def write_split_csv(spark, sf):
    df = M.split_time(table(spark, sf, "orders"), "o_orderdate", 0.2, tiebreak=["o_orderkey"])
    paths = IO.write_split_csv(df, _scratch(spark, "split"), ["o_totalprice", "o_orderpriority"], "o_orderstatus", key=["o_orderkey"])

    def side(part):
        x = IO.read_csv(spark, paths[f"X_{part}"], "o_orderkey long, o_totalprice double")
        y = IO.read_csv(spark, paths[f"y_{part}"], "o_orderkey long, o_orderstatus string")
        return x.join(y, "o_orderkey").withColumn("split", F.lit(part))

    return side("train").unionByName(side("val"))


@register("write_history_csv", HISTORY_SQL)
def write_history_csv(spark, sf):
    path = IO.write_history_csv(event_history(spark, sf), _scratch(spark, "history"))
    return IO.read_csv(spark, path, "candidate long, depth long, reward double")
