"""Inputs of the registered queries: the driver tables and the derived fixtures.

Every fixture is one SQL text run unchanged by Spark and by the DuckDB oracle
(``FIXTURES.md`` part 2), so both engines see the same NULLs and duplicates.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import nan_to_null
from ..session import configure

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Fixed fixture definitions (same text in both engines).
FIXTURES = {
    "orders_gappy": (
        "SELECT o_orderkey, o_custkey, o_orderdate, "
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_n, "
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority_n FROM orders"
    ),
    "lineitem_gappy": (
        "SELECT *, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS price_n FROM lineitem"
    ),
    "events_dup": "SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events",
    "orders_one_gap": (
        "SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN NULL ELSE o_totalprice END AS price_g, 'x' AS fixed FROM orders"
    ),
    "docs_labelled": (
        "SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality, l.toxic "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or fixture as a DataFrame (NaN -> NULL at ingest)."""
    configure(spark)
    if name in FIXTURES:
        for t in TABLES:
            if re.search(rf"\b{t}\b", FIXTURES[name]):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(FIXTURES[name])
    return nan_to_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def with_fixture(sql: str, *names: str) -> str:
    """Prefix oracle SQL with the fixture CTEs it uses."""
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names)
    return f"WITH {ctes} {sql}"
