"""Operator 12: how far the sources of a language differ in their words, by in-mapper stripes.

1. *Fold.*  Each partition folds whole documents into stripes: a hash table of ``(lang, term)`` with the
   term's document frequency and its counts by source.  A table of ``STRIPE_CELLS`` counts is spilled
   (emitted and begun anew), so a task's memory is bounded; a frequent term costs one stripe a spill,
   not one row an occurrence.
2. *Merge.*  Stripes are dealt by (lang, term), sorted, and merged one key at a time.  Stripes of fewer
   than ``min_docs`` documents end here.  The merged stripes are written to the shared folder; each
   language also has a stripe of the empty term, which lists all its sources.
3. *Emit.*  A language's stripes are dealt to buckets of about ``BUCKET`` terms, each with the list of
   the language's sources and totals.  A bucket adds up its share of the distances of all pairs of
   sources and each source's largest ``top`` terms.  Sums and final ranks over the buckets are left to
   Spark.

Smoothed shares are ``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))``; all arithmetic is in whole
numbers.  The result holds every ordered pair of sources of a language, as asked: work and rows grow
with the square of a language's number of sources.  A task holds the stripes of one bucket, ``RUN``
shares and the distances of ``PAIR_BLOCK`` sources to all others.

Edge cases: NULL text, language and source are read as ''.  Groups without a term, and languages
without a kept term (V = 0), have their pairs, of value 0 where V = 0.  Equal values rank by the UTF-8
bytes of the item.  Repeated rows count as often as they occur.  An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, written

#: Cells (a term's count in a source) held by a partition before its stripes are spilled.
STRIPE_CELLS = 1 << 20
#: Terms a bucket is meant to hold, or twice the language's sources if that is more.
BUCKET = 1 << 12
#: Shares (terms x sources) compared at a time, and sources whose distances are held at a time.
RUN, PAIR_BLOCK = 1 << 20, 256
SMOOTH, UNIT = 5, 1_000_000_000
MIN_DOCS, TOP = 30, 50
#: Parts in which a language's stripes look up what holds for the whole language.
SALTS = 64

#: Bytes of a term as they are, A-Z lower-cased; all others separate.
_TERM_BYTES = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of ``values``, each ending where ``ends`` says."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, rising, and the sums of ``values`` over each."""
    if not len(key):
        return (key, *values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[first], *[np.add.reduceat(v[order], first) for v in values])


class Stripes:
    """A hash table of terms, each with a sparse stripe: for each source the documents and occurrences.

    The hash gives a term its row; what documents add is noted as (row, source, documents, occurrences) and
    summed whenever the notes have doubled."""

    def __init__(self):
        rows = count()
        self.index: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(rows.__next__))
        self.sources: dict[str, int] = defaultdict(count().__next__)
        self.notes: list[np.ndarray] = []
        self.cells = np.zeros((4, 0), dtype=np.int64)
        self.noted = 0

    def add(self, lang: str, source: str, text: str | None) -> None:
        found = Counter(terms(text))
        found[b""] = 1  # the empty term counts documents by source
        note = np.empty((4, len(found)), dtype=np.int64)
        note[0] = list(map(self.index[lang].__getitem__, found))
        note[1], note[2], note[3] = self.sources[source], 1, list(found.values())
        self.notes.append(note)
        self.noted += len(found)

    def compact(self) -> int:
        """Sum the notes; the number of cells."""
        if self.notes:
            row, source, docs, n = np.concatenate([self.cells, *self.notes], axis=1)
            width = len(self.sources)
            key, docs, n = summed(row * width + source, docs, n)
            self.cells = np.stack([key // width, key % width, docs, n])
            self.notes, self.noted = [], 0
        return self.cells.shape[1]

    def batches(self):
        """The stripes ``lang, term, df, sources, counts``."""
        self.compact()
        row, source, docs, n = self.cells
        langs, words = [], []
        for lang, of in self.index.items():
            langs += [lang] * len(of)
            words += of
        at = np.fromiter((k for of in self.index.values() for k in of.values()), dtype=np.int64, count=len(words))
        order = np.argsort(at)  # rows are numbered as they were met, over all languages
        first = np.searchsorted(row, np.arange(len(words)))
        whole = pa.RecordBatch.from_arrays([
            pa.array(langs, pa.string()).take(pa.array(order)), pa.array(words, pa.binary()).take(pa.array(order)).cast(pa.string()),
            pa.array(np.add.reduceat(docs, first) if len(first) else docs, pa.int64()),
            lists(np.append(first[1:], len(row)), pa.array(list(self.sources), pa.string()).take(pa.array(source))),
            lists(np.append(first[1:], len(row)), pa.array(n, pa.int64()))], names=["lang", "term", "df", "sources", "counts"])
        for lo in range(0, len(words), 10_000):
            yield whole.slice(lo, 10_000)


def fold(batches):
    """Documents ``(lang, source, text)`` to stripes, spilled whenever they hold ``STRIPE_CELLS`` cells."""
    stripes = Stripes()
    for batch in batches:
        for lang, source, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            stripes.add(lang, source, text)
            if stripes.noted >= STRIPE_CELLS and stripes.compact() >= STRIPE_CELLS:
                yield from stripes.batches()
                stripes = Stripes()
    yield from stripes.batches()


def combined(batch: pa.RecordBatch, min_docs: int) -> pa.RecordBatch:
    """Sorted stripes with those of one key made one; all but the last key's must reach ``min_docs`` (the empty term need not)."""
    lang, term, df, sources, counts = batch.columns
    n = len(df)
    new = np.ones(n, dtype=bool)
    new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    docs = np.add.reduceat(df.to_numpy(), first)
    stays = (docs >= min_docs) | pc.equal(term.take(pa.array(first)), "").to_numpy(zero_copy_only=False)
    stays[-1] = True
    rows = pa.array(np.repeat(stays, np.diff(np.append(first, n))))
    sources, counts, run = sources.filter(rows), counts.filter(rows), np.cumsum(new[rows.to_numpy(zero_copy_only=False)]) - 1
    names = sources.flatten().dictionary_encode()
    width = max(len(names.dictionary), 1)
    key = np.repeat(run, sources.value_lengths().to_numpy()) * width + names.indices.to_numpy()
    key, count_ = summed(key, counts.flatten().to_numpy())
    ends = np.searchsorted(key, (np.arange(int(stays.sum())) + 1) * width)
    at = pa.array(first[stays])
    out = [lang.take(at), term.take(at), pa.array(docs[stays]), lists(ends, names.dictionary.take(pa.array(key % width))), lists(ends, pa.array(count_))]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, batch.schema.types)], schema=batch.schema)


def merge(min_docs: int):
    """Function of stripes sorted by key: one stripe a key, those of fewer than ``min_docs`` documents left out."""

    def run(batches):
        held = None  # the last key may go on
        for batch in batches:
            if batch.num_rows:
                batch = combined(batch if held is None else pa.concat_batches([held, batch]), min_docs)
                held = batch.slice(batch.num_rows - 1)
                yield batch.slice(0, batch.num_rows - 1)
        if held is not None and (held.column(2)[0].as_py() >= min_docs or held.column(1)[0].as_py() == ""):
            yield held

    return run


def merged_stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """Merged stripes ``lang, term, df, sources, counts`` of the kept terms, and of the empty term of each language."""
    rows = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    partial = rows.mapInArrow(fold, STRIPE).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return partial.mapInArrow(merge(min_docs), STRIPE)


def shares(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * (count + 5) / size)``, exactly; ``size`` is N + 5 * V."""
    if len(count) and int(count.max()) + SMOOTH >= (1 << 62) // UNIT:
        return np.array([1 + UNIT * (int(c) + SMOOTH) // int(s) for c, s in zip(count, size)], dtype=np.int64)
    return 1 + UNIT * (count + SMOOTH) // size


class Bucket:
    """Distances and largest terms of one bucket of a language's stripes."""

    def __init__(self, key: tuple[str, int], top: int):
        self.key, self.top = key, top
        self.sources: list[str] = []
        self.sizes: list[int] = []
        self.terms: list[str] = []
        self.cells: list[tuple[list[int], list[int]]] = []

    def head(self, source: str, size: int) -> None:
        self.sources.append(source)
        self.sizes.append(size)

    def begin(self, size: int) -> None:
        """All sources are known: ``size`` is the language's N + 5 * V."""
        self.size, self.place = size, {s: k for k, s in enumerate(self.sources)}

    def add(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.terms.append(term)
        self.cells.append(([self.place[s] for s in sources], counts))

    def end(self):
        n, sizes = len(self.terms), np.array(self.sizes, dtype=np.int64)
        row = np.repeat(np.arange(n), [len(c) for _, c in self.cells])
        at = np.array([k for s, _ in self.cells for k in s], dtype=np.int64)
        count_ = np.array([k for _, c in self.cells for k in c], dtype=np.int64)
        p = shares(count_, sizes[at])
        _, whole = summed(row, count_)
        q = shares(whole, np.full(n, self.size, dtype=np.int64))
        yield from self.largest(row, at, p - q[row])
        yield from self.distances(row, at, p, shares(np.zeros(len(sizes), dtype=np.int64), np.maximum(sizes, 1)))

    def largest(self, row: np.ndarray, at: np.ndarray, above: np.ndarray):
        """The ``top`` most over-used terms of each source; terms come in rising order, which decides ties."""
        fine = above > 0
        row, at, above = row[fine], at[fine], above[fine]
        order = np.lexsort((row, -above, at))
        row, at, above = row[order], at[order], above[order]
        first = np.searchsorted(at, at)
        best = np.arange(len(at)) - first < self.top
        yield self.batch("term", at[best], [self.terms[r] for r in row[best]], above[best])

    def distances(self, row: np.ndarray, at: np.ndarray, p: np.ndarray, zero: np.ndarray):
        """Distances of all pairs of sources over the bucket's terms, ``PAIR_BLOCK`` sources and ``RUN`` shares at a time."""
        g, n = len(zero), len(self.terms)
        step = max(RUN // max(g, 1), 1)
        for lo in range(0, g - 1, PAIR_BLOCK):
            block = range(lo, min(lo + PAIR_BLOCK, g - 1))
            far = np.zeros((len(block), g), dtype=np.int64)
            for begin in range(0, n, step):
                of = slice(*np.searchsorted(row, (begin, begin + step)))
                dense = np.repeat(zero[:, None], min(step, n - begin), axis=1)
                dense[at[of], row[of] - begin] = p[of]
                for k, i in enumerate(block):
                    far[k, i + 1 :] += np.abs(dense[i + 1 :] - dense[i]).sum(axis=1)
            for k, i in enumerate(block):
                yield self.batch("pair", np.full(g - i - 1, i), self.sources[i + 1 :], far[k, i + 1 :])

    def batch(self, part: str, left: np.ndarray, item: list[str], value: np.ndarray) -> pa.RecordBatch:
        n = len(item)
        return pa.RecordBatch.from_arrays([
            pa.array([self.key[0]] * n, pa.string()), pa.array([self.sources[i] for i in left], pa.string()), pa.array([part] * n, pa.string()),
            pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def emit(top: int):
    """Function of a partition's buckets, each its sources (kind 0), the language's total (kind 1), then its stripes by term."""

    def run(batches):
        bucket = None
        for batch in batches:
            for lang, number, kind, name, size, sources, counts in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if bucket is None or bucket.key != (lang, number):
                    if bucket is not None:
                        yield from bucket.end()
                    bucket = Bucket((lang, number), top)
                if kind == 0:
                    bucket.head(name, size)
                elif kind == 1:
                    bucket.begin(size)
                else:
                    bucket.add(name, sources, counts)
        if bucket is not None:
            yield from bucket.end()

    return run


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``: distances to the language's other sources (``pair``) and the
    source's most over-used terms (``term``), as the module says."""
    stripes = written(merged_stripes(docs, text_col, lang_col, source_col, min_docs), "stripes")
    groups = stripes.where("term = ''").select("lang", F.explode("sources").alias("source"))
    counts = stripes.where("term <> ''").select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    counts = counts.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    kept = stripes.groupBy("lang").agg(F.sum((F.col("term") != "").cast("long")).alias("v"), F.max(F.when(F.col("term") == "", F.size("sources"))).alias("g"))
    sizes = written(
        groups.join(counts, ["lang", "source"], "left").join(kept, "lang")
        .select("lang", "source", "v", "g", F.coalesce("n", F.lit(0)).alias("n")), "stripe-sizes")
    langs = sizes.groupBy("lang").agg(F.first("v").alias("v"), F.first("g").alias("g"), F.sum("n").alias("n"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / F.greatest(F.lit(BUCKET), 2 * F.col("g")))).cast("int")
    none = [F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("array<long>").alias("counts")]
    number = F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket")
    size = (F.col("n") + SMOOTH * F.col("v")).alias("size")
    heads = sizes.select("lang", number, F.lit(0).alias("kind"), F.col("source").alias("name"), size, *none)
    totals = langs.select("lang", number, F.lit(1).alias("kind"), F.lit("").alias("name"), size, *none)
    # one language may hold most stripes: they meet their language's number of buckets in SALTS parts
    salted = langs.select("lang", "v", "g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = stripes.where("term <> ''").withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "salt"])
    rows = rows.select(
        "lang", F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket"), F.lit(2).alias("kind"),
        F.col("term").alias("name"), F.lit(0).cast("long").alias("size"), "sources", "counts")
    dealt = heads.unionByName(totals).unionByName(rows).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "kind", "name")
    found = written(dealt.mapInArrow(emit(top), "lang string, source string, part string, item string, value long"), "divergence-parts")
    far = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    far = far.select("lang", "part", "value", ways.alias("way")).select("lang", "way.source", "part", "way.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    near_top = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return far.withColumn("rank", rank).unionByName(near_top)
