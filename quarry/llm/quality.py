"""Operator 2: quality rules, judged per document and per host (DataFrame functions only).

Every document gets counts of its whole text and a base verdict.  Hosts (``host_col``) are then
judged by their documents' failures: a host's failure rate is shrunk towards the rate of all
hosts by a beta prior whose strength is estimated from the spread of the hosts' own rates
(method of moments), so that a host of few documents needs more evidence than a large one.
Documents of a host whose shrunken rate is above ``max_host_rate`` are not kept.

Repeated 5-word windows are found inside each row: windows are hashed, sorted with their places,
and neighbours of equal hash are compared word by word; nothing is exploded.

Edge cases: a NULL or empty text has no words (all counts 0, base_failed).  Rows without a host
form one host.  Repeated rows count and are returned as often as they occur.  An empty table
gives an empty result.  Columns other than the three named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, col, written

SPACES = r"[\x20\x09-\x0D]"
WINDOW = 5
#: A hosts table is broadcast up to this size.
BROADCAST_BYTES = 8 << 20


def with_counts(docs: DataFrame, text: Column, window: int = WINDOW) -> DataFrame:
    """``docs`` with the counts ``n_words word_chars n_symbols n_dup_lines n_repeat_words`` of ``text``."""
    w = window
    steps = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    steps = steps.withColumns({
        "_words": F.filter(F.split("_text", SPACES + "+"), lambda x: x != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
    }).drop("_text")
    steps = steps.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_keys": F.when(F.size("_words") >= w, F.transform(
            F.sequence(F.lit(0), F.size("_words") - w),
            lambda i: F.xxhash64(*[F.col("_words")[i + k] for k in range(w)]))).otherwise(F.array().cast("array<bigint>")),
    }).drop("_lines")
    # window places in the order of their hashes, for the texts that have any window twice
    steps = steps.withColumn("_order", F.when(
        F.size(F.array_distinct("_keys")) < F.size("_keys"),
        F.array_sort(F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    steps = steps.drop("_keys")

    def same(a: Column, b: Column) -> Column:
        return (a["k"] == b["k"]) & (F.slice(F.col("_words"), a["i"] + 1, w) == F.slice(F.col("_words"), b["i"] + 1, w))

    order = F.col("_order")
    steps = steps.withColumn("_places", F.when(order.isNotNull(), F.array_sort(F.transform(
        F.filter(order, lambda s, j: (
            F.when(j > 0, same(s, order[F.greatest(j - 1, F.lit(0))])).otherwise(F.lit(False))
            | F.when(j + 1 < F.size(order), same(s, order[F.least(j + 1, F.size(order) - 1)])).otherwise(F.lit(False)))),
        lambda s: s["i"]))))
    places = F.col("_places")
    steps = steps.drop("_order", "_words").withColumn("_new", F.transform(
        places, lambda p, j: F.when(j + 1 < F.size(places), F.least(F.lit(w), places[F.least(j + 1, F.size(places) - 1)] - p)).otherwise(w)))
    return steps.withColumn("n_repeat_words", F.coalesce(
        F.aggregate("_new", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_places", "_new")


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the prior, from ``n`` and ``failed`` of all hosts."""
    r = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("h")).first()
    if not r["n"]:
        return 0.0, 1.0
    mean = r["f"] / r["n"]
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - mean, 2)).alias("s")).first()["s"] / r["n"]
    between = spread - mean * (1 - mean) * r["h"] / r["n"]  # what chance alone would give goes
    strength = mean * (1 - mean) / between - 1 if between > 0 else 1e6
    return mean, min(max(strength, 1.0), 1e6)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_pct: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed``, ``host_fail_rate`` and ``kept``."""
    base = with_counts(docs.select(col(id_col).alias("_id"), col(host_col).alias("_host"), col(text_col).alias("_t")), F.col("_t"))
    base = written(base.drop("_t").withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))), "quality")
    hosts = base.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = written(hosts, "quality-hosts")
    mean, strength = beta_prior(hosts)
    rates = hosts.select(
        F.col("_host").alias("_h"),
        F.round((F.col("failed") + mean * strength) / (F.col("n") + strength), 6).alias("host_fail_rate"))
    size = hosts.agg(F.sum(F.coalesce(F.octet_length(F.col("_host").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    judged = base.join(broadcast_if(rates, size, BROADCAST_BYTES), F.col("_host").eqNullSafe(F.col("_h")))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_fail_rate") <= max_host_rate)).alias("kept"), "host_fail_rate")
