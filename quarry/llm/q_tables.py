"""Queries of the operators over embeddings, source groups and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sharding, whitening
from .common import register, table
from .divergence import divergences


@register("op11_embedding_whitening")
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    out = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained[: whitening.COMPONENTS]])
    return out.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained.cast("array<double>"), F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
sized AS (SELECT lang, source, term, c, sum(c) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source) AS n FROM cells),
p AS (SELECT lang, source, term, c, 1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // n AS p FROM sized),
whole AS (SELECT lang, term, sum(c) AS c FROM cells GROUP BY ALL),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@register("op12_source_divergence", OP12_SQL)
def op12(spark, sf_dir):
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS steps),
d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, size, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS h,
  xor(4294967295, list_reduce(list_transform(range(1, size - 7), lambda i: CAST('0x' || substr(hex(encode(t)), 2 * i - 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, crc.steps[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32 FROM d, crc),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 24 // sum(size) OVER () AS shard FROM k)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM o
"""


@register("op13_sharding", OP13_SQL)
def op13(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
