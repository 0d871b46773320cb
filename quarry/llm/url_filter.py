"""Operator 10: URL filter rules, host word segmentation and naive Bayes for the rest.

A rule is a host and a path prefix; it fits its host and all subdomains, the longest rule wins.
URLs that no rule fits get the verdict of a multinomial naive Bayes classifier over words:

1. Words (runs of letters of any script) of all pages' texts are counted.  Only substrings of host
   labels can matter, so the counts are joined to the substrings of the distinct labels, frequent ones
   apart; the dictionary has no size limit.
2. Each distinct label is split by unigram Viterbi: a known word costs -log of its share, an
   unknown character more than any word, and what no word covers stays one piece.
3. Tokens are the words of the host and the words and numbers of the path (a number counts as
   ``#``).  The URLs that a rule judged are the labelled ones, all of them; token counts per
   verdict, add-one smoothed, give each token's log-odds, joined back to the distinct URLs.

Scores are summed per distinct URL, so a host with a third of all rows is scored once.

Edge cases: a NULL url or one without ``://`` has an empty host and path and no tokens; its
verdict is the class prior's.  Equal odds, and no labelled rows at all, mean allow.  Of rules of
one length, the one listed first wins.  Repeated rows are kept.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.splitjoin import Lookup, counted
from .common import broadcast_if, col, written

#: (verdict, rule): a rule is a host and what its paths begin with.
Rule = tuple[str, str]
#: A label of a host name has at most 63 characters (fixed by the format), so no longer word can occur in one.
LONGEST = 63
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    # (?>...): a later :// (in a query, say) is no other place to begin
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; NULLs where none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        pair = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, pair) if chain is None else chain.when(fits, pair)
    return out if chain is None else chain.otherwise(out)


def visible_words(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))  # whole words of any script


def segment(label: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest split: ``known`` has the count of the word at (start, length)."""
    unknown = math.log(total + 1) + 12.0  # a character that no word covers; dearer than any word
    best, back = [0.0] + [math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        best[end], back[end] = best[end - 1] + unknown, end - 1
        for start in range(max(0, end - LONGEST), end):
            if n := known.get((start, end - start)):
                cost = best[start] + math.log(total) - math.log(n)
                if cost < best[end]:
                    best[end], back[end] = cost, start
    out: list[str] = []
    end, open_ = len(label), False
    while end > 0:
        start = back[end]
        covered = (start, end - start) in known
        if not covered and open_:
            out[-1] = label[start:end] + out[-1]
        else:
            out.append(label[start:end])
        open_, end = not covered, start
    return out[::-1]


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words array) of the distinct ``labels``; ``words`` has (word, n)."""
    total = words.agg(F.sum("n")).first()[0] or 0
    sub = labels.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.length("label"), F.lit(1)))))
    sub = sub.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.least(F.lit(LONGEST), F.length("label") - F.col("i") + 1), F.lit(1)))))
    sub = sub.select("label", "i", "k", F.col("label").substr(F.col("i"), F.col("k")).alias("word"))
    # every label has an "e": a frequent substring must not meet in one task
    known = Lookup(words.select(F.col("word").alias("value"), "n"), counted(sub, F.col("word")), BROADCAST_BYTES)
    named = known.join(sub, F.col("word")).where("n IS NOT NULL").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(sub.columns)], "n")
    found = named.groupBy("label").agg(F.collect_list(F.struct("i", "k", "n")).alias("found"))
    both = labels.join(found, "label", "left")

    @F.arrow_udf("array<string>")
    def split(label: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([
            segment(a, {(f["i"] - 1, f["k"]): f["n"] for f in b or []}, total)
            for a, b in zip(label.to_pylist(), found.to_pylist())], pa.list_(pa.string()))

    return both.select("label", split("label", "found").alias("words"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, host, path, rule, verdict, and the classifier's log-odds of ``allow``."""
    base = pages.select(col(id_col).alias("_id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    base = base.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    base = base.select("_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"))
    urls = written(base.groupBy("host", "path", F.col("_verdict").alias("judged")).agg(F.count("*").alias("n")), "url-distinct")

    words = pages.select(F.explode(visible_words(col(html_col))).alias("word")).where(F.length("word") <= LONGEST)
    words = written(words.groupBy("word").agg(F.count("*").alias("n")), "url-words")
    labels = urls.select("host").distinct().select("host", F.explode(F.split("host", r"\.")).alias("label")).where("label != ''")
    split = written(segmented(labels.select("label").distinct(), words), "url-labels")
    host_words = written(labels.join(split, "label").select("host", F.explode("words").alias("token")), "url-host-words")
    size = host_words.agg(F.sum(F.octet_length("host") + F.octet_length("token") + 32)).first()[0] or 0
    host_words = broadcast_if(host_words, size, BROADCAST_BYTES)  # a host may have a third of all URLs

    path_words = urls.select("host", "path", F.explode(F.regexp_extract_all(F.lower("path"), F.lit(r"[a-z]+|[0-9]+|[^\x00-\x7F]+"), F.lit(0))).alias("token"))
    path_words = path_words.withColumn("token", F.when(F.col("token").rlike("^[0-9]+$"), "#").otherwise(F.col("token")))
    of_url = urls.join(host_words, "host").select("host", "path", F.concat(F.lit("h:"), "token").alias("token"))
    tokens = of_url.unionByName(path_words.withColumn("token", F.concat(F.lit("p:"), "token")))
    tokens = written(tokens.groupBy("host", "path", "token").agg(F.count("*").alias("times")), "url-tokens")

    labelled = tokens.join(urls.where("judged IS NOT NULL"), ["host", "path"])
    is_allow = F.col("judged") == "allow"
    counts = written(labelled.groupBy("token").agg(
        F.sum(F.when(is_allow, F.col("n") * F.col("times")).otherwise(0)).alias("a"),
        F.sum(F.when(~is_allow, F.col("n") * F.col("times")).otherwise(0)).alias("b")), "url-counts")
    t = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v"), F.sum(F.octet_length("token") + 24).alias("bytes")).first()
    d = urls.where("judged IS NOT NULL").agg(F.sum(F.when(is_allow, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(is_allow, 0).otherwise(F.col("n"))).alias("b")).first()
    prior = math.log(((d["a"] or 0) + 1) / ((d["b"] or 0) + 1))
    most = [(t["a"] or 0) + t["v"], (t["b"] or 0) + t["v"]]
    odds = counts.select("token", (F.log(F.col("a") + 1) - F.log(F.col("b") + 1) + math.log(max(most[1], 1)) - math.log(max(most[0], 1))).alias("o"))
    scored = tokens.join(broadcast_if(odds, t["bytes"] or 0, BROADCAST_BYTES), "token").groupBy("host", "path").agg(F.sum(F.col("o") * F.col("times")).alias("o"))
    # rows without a URL, and those of a frequent one, stay where they are
    at = F.concat("host", F.lit("/"), "path")
    known = Lookup(scored.select(at.alias("value"), (F.col("o") + prior).alias("_odds")), urls.select(at.alias("value"), "n"), BROADCAST_BYTES)
    judged = known.join(base, at).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(base.columns)], "_odds")
    odds_of = F.round(F.coalesce("_odds", F.lit(prior)), 6)
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_verdict", F.when(odds_of >= 0, "allow").otherwise("block")).alias("verdict"), odds_of.alias("log_odds"))
