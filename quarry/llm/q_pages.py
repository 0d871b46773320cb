"""Queries of the operators over web pages."""

from __future__ import annotations

from . import html_main, url_filter, warc
from .common import register, shared_path, table

#: The rules of the registered query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@register("op10_url_filter")
def op10(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first, count(*) AS c FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


@register("op8_warc_zstd", OP8_SQL)
def op8(spark, sf_dir):
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op9_html_main_text")
def op9(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))
