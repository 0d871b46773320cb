"""Queries of the operators that hold documents against each other or against a benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import register, table
from .decontam import leaks
from .neardup import near_duplicates

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + 9), ' ') AS k
        FROM it, unnest(range(1, greatest(len(ws) - 8, 2))) AS u(i) WHERE len(ws) > 0),
dw AS (SELECT rid, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k
       FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, greatest(len(ws) - n + 2, 1))) AS u(i)),
hit AS (SELECT rid, i, win.n, item FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
w AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit), unnest(range(0, n)) AS u(j) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (rid) LEFT JOIN t USING (rid)
"""


@register("op5_decontamination", OP5_SQL)
def op5(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


@register("op6_near_duplicates")
def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
