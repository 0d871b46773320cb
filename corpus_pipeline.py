"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

1. ``language_id``: documents without any language (no letter, NULL or empty text) go.
2. ``near_dedup``: of each group of near duplicates the document of the smallest id stays.
3. ``decontamination``: documents that hold a test phrase of ``benchmark`` go.
4. ``pii``: personal data in ``text`` become pseudonyms; ``n_chars`` follows.
5. ``tokens``: the texts become token ids; ``round_trip`` says whether they decode to the text.

Stages 1 to 4 return the columns of ``documents``, extra ones included.  A stage of an empty table
returns an empty table.  SQL can't express the stages; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, neardup, pii, tokenize_bpe
from quarry.llm.common import ship, table, written
from quarry.llm.q_text import PII_KEY, tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = decontam.with_leaks(rows, table(spark, sf_dir, "benchmark"), "leaks", F.col(f"c{names.index('text')}"))
    return found.where(F.size("leaks.spans") == 0).drop("leaks").toDF(*names)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    names = docs.columns
    both = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("new", pii.pseudonyms(F.col(f"c{names.index('text')}"), PII_KEY))
    text = F.col("new.text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return both.select(*[new.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = tokenize_bpe.encode_documents(docs, tokenizer_file(), keep=("doc_id", "lang", "source", "text"))
    return out.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_pseudonyms),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
