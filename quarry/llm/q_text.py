"""Queries of the operators that judge or rewrite single texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import licenses
from .common import register, table
from .langid import identify
from .pii import mask
from .quality import judge
from .tokenize_bpe import encode_documents


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op1_sentencepiece")
def op1(spark, sf_dir):
    out = encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, i, list_slice(ws, i, i + 4) AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM dup, unnest(range(0, 5)) AS u(d) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) AS n
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM failed GROUP BY source),
al AS (SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS h FROM hosts),
bt AS (SELECT m, sum(hosts.n * power(hosts.f / hosts.n - m, 2)) / max(al.n) - m * (1 - m) * max(h) / max(al.n) AS v FROM hosts, al GROUP BY m),
pr AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM bt),
rt AS (SELECT source, round((f + m * s) / (n + s), 6) AS host_fail_rate FROM hosts, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_fail_rate <= 0.5 AS kept, host_fail_rate
FROM failed JOIN rt ON failed.source IS NOT DISTINCT FROM rt.source
"""


@register("op2_quality_rules", OP2_SQL)
def op2(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


@register("op3_language_id")
def op3(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


#: The key of the registered query; a user passes a secret one.
PII_KEY = b"quarry registered query"


@register("op7_pii_pseudonyms")
def op7(spark, sf_dir):
    return mask(table(spark, sf_dir, "documents"), PII_KEY).select(
        "doc_id", "text", F.size("spans").cast("long").alias("n_pii"),
        F.array_join(F.array_sort(F.array_distinct(F.col("spans.kind"))), ",").alias("kinds"))


@register("op4_license_scan", licenses.oracle_sql())
def op4(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))
