"""Operator 3: language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1.  A trigram's vector is the product of its
letters' vectors, the first rotated twice and the second once, so order matters; a text's vector
is the sum (bundle) over all its trigrams, a language's prototype the sum over its texts.  A text
gets the language whose prototype has the largest cosine with its own vector.

Letters are the characters that Unicode calls alphabetic, lower-cased; whatever stands between
letters counts as one space.  Prototype sums are whole numbers, so they don't depend on order.

Edge cases: a NULL text or one without a letter is ``und`` with score 0.  Rows without a language
are predicted but not learned from; with nothing to learn from, every text is ``und``.  Of equal
cosines the first language in order of name wins.  Repeated rows count as often as they occur.
Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

DIM = 512
#: Trigram vectors that a worker keeps (DIM bytes each); a full table is begun anew.
KEPT = 40_000
#: Texts of a language that learning bundles at once.
AT_ONCE = 64
UNKNOWN = "und"


class Bundler:
    """Text vectors; holds the vectors of letters and of recent trigrams."""

    def __init__(self, dim: int = DIM, seed: int = 7):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((KEPT, dim), np.int8)
        self.kind = np.fromiter((ord(" ") if not chr(i).isalpha() else i for i in range(0x110000)), np.int64, 0x110000)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            bits = np.random.Generator(np.random.PCG64([self.seed, c])).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[c] = 2 * bits - 1
        return self.letters[c]

    def trigrams(self, text: str | None) -> np.ndarray:
        """The trigrams of a text, three 21-bit code points each; none without a letter."""
        chars = self.kind[np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = chars == ord(" ")
        space[1:] &= space[:-1].copy()
        space[0] = False
        chars = chars[~space]
        return chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]

    def _row(self, code: int) -> int:
        row = self.rows[code] = len(self.rows)
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        self.table[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return row

    def vector(self, trigrams: np.ndarray) -> np.ndarray:
        """The bundle of trigrams as whole numbers."""
        codes, counts = np.unique(trigrams, return_counts=True)
        total = np.zeros(self.dim, np.int64)
        for s in range(0, len(codes), KEPT // 8):
            part, n = codes[s : s + KEPT // 8].tolist(), counts[s : s + KEPT // 8]
            if len(self.rows) + len(part) > KEPT:
                self.rows.clear()
            get = self.rows.get
            rows = [r if (r := get(c)) is not None else self._row(c) for c in part]
            # sums of whole numbers below 2**24 (2**53) are exact in float32 (float64)
            kind = np.float32 if n.sum() < 1 << 24 else np.float64
            total += (n.astype(kind) @ self.table[rows].astype(kind)).astype(np.int64)
        return total


_BUNDLERS: dict[tuple[int, int], Bundler] = {}


def bundler(dim: int, seed: int) -> Bundler:
    if (dim, seed) not in _BUNDLERS:
        _BUNDLERS[dim, seed] = Bundler(dim, seed)
    return _BUNDLERS[dim, seed]


def learn(texts: DataFrame, dim: int = DIM, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototypes from a DataFrame (lang, text): a fixed-size vector for each language."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, np.ndarray] = {}
        make = bundler(dim, seed)

        def bundle(lang: str, some: list[np.ndarray]) -> None:
            of[lang] = of.get(lang, 0) + make.vector(np.concatenate(some))

        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if len(found := make.trigrams(text.as_py())):
                    some = waiting.setdefault(lang, [])
                    some.append(found)
                    if len(some) >= AT_ONCE or len(found) >= 1 << 20:
                        bundle(lang, waiting.pop(lang))
            for lang, some in waiting.items():
                bundle(lang, some)
        for lang, v in of.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "k", "v"])

    pairs = texts.toDF("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    summed = pairs.mapInArrow(sums, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x dim numbers, whatever the number of texts
        out.setdefault(r["lang"], np.zeros(dim))[r["k"]] = r["v"]
    return dict(sorted(out.items()))


def predict(text: Column, prototypes: dict[str, np.ndarray], dim: int = DIM, seed: int = 7) -> Column:
    """Column struct(lang_pred string, score double in 0..1)."""
    names = list(prototypes)
    unit = np.array([p / max(np.linalg.norm(p), 1e-300) for p in prototypes.values()]).reshape(len(names), dim)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = bundler(dim, seed)
        for texts in batches:
            langs, scores = [], []
            for t in texts:
                found = make.trigrams(t.as_py()) if names else ()
                v = make.vector(found) if len(found) else None
                if v is None or not (size := np.linalg.norm(v)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = unit @ v / size
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return apply(text)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3 (a NULL id counts as empty text)."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents of folds 0 and 2, predict all: id, held_out, lang_pred, score."""
    prototypes = learn(docs.where(fold(id_col) != 1).select(col(lang_col).cast("string"), col(text_col)))
    out = docs.select(col(id_col), (fold(id_col) == 1).alias("held_out"), predict(col(text_col), prototypes).alias("_p"))
    return out.select(col(id_col), "held_out", F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def has_letters(text: Column, dim: int = DIM, seed: int = 7) -> Column:
    """Whether a text has a letter, and so a trigram; false for NULL."""

    @F.arrow_udf("boolean")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = bundler(dim, seed)
        for texts in batches:
            yield pa.array([len(make.trigrams(t.as_py())) > 0 for t in texts], pa.bool_())

    return apply(text)


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language at all, columns unchanged.  Where nothing could be
    learned every text with a letter stays.  No text is rejected for a small score: see the README."""
    prototypes = learn(docs.where(fold(id_col) != 1).select(col(lang_col).cast("string"), col(text_col)))
    if not prototypes:
        return docs.where(has_letters(col(text_col)))
    return docs.where(predict(col(text_col), prototypes)["lang_pred"] != UNKNOWN)
