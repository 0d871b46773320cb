"""Operator 5: benchmark decontamination by an FM-index over each shard of documents.

Texts become words (A-Z lower-cased, runs of digits, letters and non-ASCII characters).  The test
phrases are the items' windows of ``window`` consecutive words, or the whole item if it is shorter.

A shard (one Arrow batch of documents, split at ``SHARD`` symbols) is indexed like this:

1. Words that no item has separate; what lies between them is a run.  A run shorter than the
   shortest phrase cannot hold one and is left out.  Each separator is a symbol of its own, so
   no suffix comparison crosses a run.
2. The suffix array comes from prefix doubling over the suffixes that still tie, the transform
   of the shard from the suffix array, and a wavelet tree (as a wavelet matrix) ranks its symbols.
3. All phrases are searched backwards at once; a phrase's row range shrinks by one word a step.
4. Rows are located by walking back to the next sampled suffix position (each ``SAMPLE``-th, and
   every run's first word).
5. A document's occurrences merge into spans of words to remove.

Items are searched in blocks of at most about ``block_bytes`` of text, so what a worker holds does
not grow with the benchmark; one block needs no shuffle at all, several are merged by text.

Edge cases: NULL texts have no words; items without words are never found; an item without an id
marks its words but is not listed; equal item ids are listed once.  Repeated rows get equal
results.  Empty tables give no rows or no hits.  Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, written

WINDOW = 10
#: Symbols of an index at most (a longer document has one of its own), and the distance of samples.
SHARD, SAMPLE = 1 << 21, 16
BLOCK_BYTES = 8 << 20
SPANS = "array<struct<start int, end int>>"
RESULT = f"struct<n_words int, spans {SPANS}, items array<string>>"
#: Bytes of words stay (capitals as small letters), all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class BitRanks:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)


class WaveletTree:
    """Ranks of any symbol in a sequence, level by level from the highest bit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels: list[tuple[int, BitRanks, int]] = []
        for bit in reversed(range(max(1, (symbols - 1).bit_length()))):
            ones = (sequence >> bit & 1).astype(bool)
            self.levels.append((bit, BitRanks(ones), int(len(ones) - ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        every = np.arange(symbols)
        self.start = self._down(every, np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, ranks, zeros in self.levels:
            ones = ranks.ones(i)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place i."""
        return self._down(symbol, i) - self.start[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; symbol 0 is a separator, and separators compare by their place.

    The text ends with a separator, so ties end within a run."""
    n = len(text)
    separators = np.flatnonzero(text == 0)
    first = text + len(separators)
    first[separators] = np.arange(len(separators))
    places = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)  # the first place of each suffix's group of ties
    ordered = first[places]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(new)
    rank[places] = starts[np.cumsum(new) - 1]
    tied = np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))
    open_ = places[tied]
    length = 1
    while len(open_):
        key = rank[open_] << 32 | rank[open_ + length]
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        old = key >> 32
        j = np.arange(len(key))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = old + new_start(j, new) - new_start(j, group)
        rank[open_] = place
        sizes = np.diff(np.append(np.flatnonzero(new), len(key)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        length *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def new_start(j: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each place the place at which its group starts."""
    return j[new][np.cumsum(new) - 1]


class FMIndex:
    """Counts and locates phrases of symbols 1..symbols-1 in runs that symbol 0 separates."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        last = text[order - 1]  # the symbol before each suffix
        self.tree = WaveletTree(last, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled, self.at = BitRanks(sampled), order[sampled]
        self.last = last
        self.size = len(text)

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each phrase; phrases of one length."""
        grid = np.array(phrases)
        low, high = np.zeros(len(grid), np.int64), np.full(len(grid), self.size, np.int64)
        alive = np.arange(len(grid))
        for step in reversed(range(grid.shape[1])):
            symbol = grid[alive, step]
            low[alive] = self.first[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            before = self.sampled.ones(rows[left])
            here = self.sampled.ones(rows[left] + 1) > before
            out[left[here]] = self.at[before[here]] + steps[left[here]]
            left = left[~here]
            symbol = self.last[rows[left]]
            rows[left] = self.first[symbol] + self.tree.rank(symbol, rows[left])
            steps[left] += 1
        return out


class Phrases:
    """The test phrases of a block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                of = found.setdefault(tuple(w[i : i + window]), set())
                if item is not None:
                    of.add(item)
        self.symbols = len(self.ids) + 1
        self.by_length: dict[int, tuple[list[np.ndarray], list[list[str]]]] = {}
        for phrase, of in found.items():
            grid, items_of = self.by_length.setdefault(len(phrase), ([], []))
            grid.append(np.array(phrase))
            items_of.append(sorted(of))
        self.shortest = min(self.by_length, default=0)


def _runs(text: str | None, p: Phrases) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A text's number of words, the symbols, and start and length of each run that may hold a phrase."""
    w = words(text)
    symbols = np.fromiter(map(p.ids.get, w, repeat(0)), np.int64, len(w))
    edges = np.diff(np.concatenate([[0], symbols > 0, [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_ = ends - starts >= p.shortest
    return len(w), symbols, starts[long_], ends[long_]


def _merge(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _search_shard(runs: list[tuple[int, int, np.ndarray]], p: Phrases, spans: list[set], items: list[set]) -> None:
    """Adds what is found in the runs (document, its word, symbols) to the documents' spans and items."""
    doc = np.array([r[0] for r in runs])
    word = np.array([r[1] for r in runs])
    begin = np.cumsum([0] + [len(r[2]) + 1 for r in runs])[:-1]
    text = np.concatenate([np.append(r[2], 0) for r in runs])
    index = FMIndex(text, p.symbols)
    for length, (grid, of) in p.by_length.items():
        low, high = index.search(grid)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        n = (high - low)[hit]
        rows = np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = index.locate(rows)
        run = np.searchsorted(begin, at, "right") - 1
        for d, start, phrase in zip(doc[run].tolist(), (word[run] + at - begin[run]).tolist(), np.repeat(hit, n).tolist()):
            spans[d].add((start, start + length))
            items[d].update(of[phrase])


def search_texts(texts: list[str | None], p: Phrases) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Words, merged spans and found items of each text."""
    counts, spans, items = [], [set() for _ in texts], [set() for _ in texts]
    shard: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for d, text in enumerate(texts):
        n, symbols, starts, ends = _runs(text, p)
        counts.append(n)
        if p.shortest:
            for s, e in zip(starts.tolist(), ends.tolist()):
                shard.append((d, s, symbols[s:e]))
                size += e - s + 1
        if size >= SHARD:
            _search_shard(shard, p, spans, items)
            shard, size = [], 0
    if shard:
        _search_shard(shard, p, spans, items)
    return counts, [_merge(list(s)) for s in spans], [sorted(i) for i in items]


def _finder(items: list[tuple[str | None, str | None]], spark, window: int):
    sent = spark.sparkContext.broadcast(items)

    @F.arrow_udf(RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = Phrases(sent.value, window)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            counts, spans, found = search_texts(texts.to_pylist(), p)
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int32()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return find


def _merged(lists: Column) -> Column:
    @F.arrow_udf(SPANS)
    def merge(found: pa.Array) -> pa.Array:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([_merge([(s["start"], s["end"]) for s in x]) for x in found.to_pylist()], span)

    return merge(lists)


def with_leaks(docs: DataFrame, items: DataFrame, out: str, text: Column, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the column ``out``: struct(n_words, spans of words, items found)."""
    spark = docs.sparkSession
    some = items.select(col(item_id).cast("string").alias("id"), col(item_text).alias("t"))
    size = some.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    some = some.withColumn("b", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)))
    # at most about block_bytes come to the driver at once
    block = lambda b: [(r["id"], r["t"]) for r in some.where(F.col("b") == b).collect()]
    if blocks == 1:
        return docs.withColumn(out, _finder(block(0), spark, window)(text))
    found = []
    for b in range(blocks):
        one = docs.select(F.sha2(text, 256).alias("k"), _finder(block(b), spark, window)(text).alias("r"))
        found.append(written(one.where("size(r.items) > 0 OR size(r.spans) > 0").groupBy("k").agg(F.first("r").alias("r")), "decontam"))
    merged = reduce(DataFrame.unionByName, found).groupBy("k").agg(
        F.flatten(F.collect_list("r.spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("r.items")))).alias("i"))
    merged = merged.select(F.col("k").alias("_leak_key"), _merged(F.col("s")).alias("_leak_spans"), F.col("i").alias("_leak_items"))
    counted = docs.withColumn("_leak_n", _finder([], spark, window)(text)["n_words"]).withColumn("_leak_of", F.sha2(text, 256))
    joined = counted.join(merged, F.col("_leak_of") == F.col("_leak_key"), "left")
    return joined.withColumn(out, F.struct(
        F.col("_leak_n").alias("n_words"), F.coalesce("_leak_spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("_leak_items", F.array().cast("array<string>")).alias("items"))).drop("_leak_n", "_leak_of", "_leak_key", "_leak_spans", "_leak_items")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, spans (merged word ranges to remove) and the ids of found items."""
    both = with_leaks(docs.select(col(id_col), col(text_col).alias("_text")), items, "_r", F.col("_text"), **options)
    return both.select(col(id_col), *[F.col(f"_r.{c}").alias(c) for c in ("n_words", "spans", "items")])
