"""Operator 1: SentencePiece BPE encoding and decoding by a prefix table.

For a merge-type (BPE) vocabulary every prefix of a text has exactly one last token in the
encoding of that prefix.  The table of those last tokens is filled from left to right: an
Aho-Corasick automaton over the pieces gives the tokens that end at a position, and the one
that follows the last token of the shorter prefix is the one for which the *pair* of both
tokens encodes to itself.  The ids are then read backwards from the end of the text.

Differences of a SentencePiece model to a plain BPE vocabulary:

* The text gets a leading space, and spaces become U+2581.  No piece joins a character with a
  *following* U+2581, so each run of U+2581 with the word behind it encodes on its own,
  and so does what starts at a mark that no piece joins to a letter before it.  Those units are
  what the (bounded) cache holds: the recent ones, and those before them until they are pushed out.
* Pieces of several U+2581 share one score, the lowest of all, so ties go to the left.  The
  pair test does not hold under such ties; a run is merged after its word, by plain merging.
* Characters without a piece become their UTF-8 bytes.

Edge cases: NULL and empty texts encode to the end id alone and decode to "".  Every row gets
one result, repeated rows and ids included; other columns are not looked at.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

SPACE = "▁"
#: Units in each of the two generations of a worker's cache: a full one takes the older one's place.
CACHE = 100_000
#: Pairs that a worker keeps; a full table is emptied.
PAIRS = 300_000
#: Texts whose results a worker holds before it sends them.
AT_ONCE = 128
RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


def _each_byte(error: UnicodeDecodeError):
    """The library decodes every invalid byte to one U+FFFD."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("quarry-each-byte", _each_byte)


def _split(ids: list[int], at: int) -> list[list[int]]:
    """The stretches of ``ids`` between the places of ``at``."""
    cuts = [-1, *(i for i, x in enumerate(ids) if x == at), len(ids)]
    return [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:])]


class PrefixTableBPE:
    """Encoder and decoder for one SentencePiece BPE model file with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)  # for the vocabulary alone
        n = sp.vocab_size()
        self.eos = sp.eos_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.control: list[int] = []
        self.surface: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_control(i):
                self.control.append(i)
                continue
            if sp.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.surface[i] = i, bytes([value])
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.pieces = [p for p in self.ids if p.strip(SPACE)] + [SPACE] * (SPACE in self.ids)
        automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.pieces):
            automaton.add_word(p, k)
        automaton.make_automaton()
        self.automaton = automaton
        self.size = [len(p) for p in self.pieces]
        self.raw = {*self.byte_id}
        self.known = {c for p in self.pieces for c in p if c in self.ids}
        self.piece_id = [self.ids[p] for p in self.pieces]
        self.unknown = "[^" + re.escape("".join(sorted(self.known))) + "]"
        marks = re.escape("".join(sorted(self._marks())))
        line = "" if "\n" in self.known else "\n"
        # re's word characters include numerals that are not letters; after those, marks may join
        letter = "[^\\W\\d_" + re.escape("".join(sorted(c for c in self.known if c.isalnum() and not c.isalpha()))) + "]"
        self.unit = re.compile(f" *(?:{letter}++(?![^ {line}{marks}])|[^ {line}]+)| +" + (f"|{line}+" if line else ""))
        self.pair: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _marks(self) -> set[str]:
        """ASCII marks that no piece has behind a letter: before them a word of letters ends."""
        after_letters = {b for p in self.pieces for a, b in zip(p, p[1:]) if a.isalpha()}
        return {c for c in map(chr, range(33, 127)) if not c.isalnum()} - after_letters

    def merge(self, text: str) -> list[str]:
        """Plain BPE: join the best-scored adjacent pair, leftmost first, until none is a piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (s := self.score.get(joined := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, joined))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != joined:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _stays_whole(self, piece: str) -> bool:
        return self.merge(piece) == [piece]

    def _stays_apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` never joins a pair across the border."""
        get, none = self.score.get, float("-inf")
        parts = [*left, *right]
        border = len(left) - 1  # the pair (border, border + 1) holds the border
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while (best := max(scores)) > none:
            i = scores.index(best)
            if i == border:
                return False
            border -= i < border
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return True

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (a < 0: whether b is reachable at all)."""
        if a < 0:
            return self._stays_whole(self.pieces[b])
        if len(self.pair) >= PAIRS:
            self.pair.clear()
        return self._fits(-1, b) and self._stays_apart(self.pieces[a], self.pieces[b])

    def _known_run(self, text: str) -> list[int]:
        """Ids (into ``pieces``) of a run of characters that all have pieces."""
        n, size, pair = len(self.pieces), self.size, self.pair
        last: list[int | None] = [-1] + [None] * len(text)  # the last token of each prefix, by its length
        for end, k in self.automaton.iter(text):  # of one end, the longest first
            if last[end + 1] is None and (before := last[end + 1 - size[k]]) is not None:
                if (fits := pair.get(key := before * n + k)) is None:
                    fits = pair[key] = self._fits(before, k)
                if fits:
                    last[end + 1] = k
        out, end = [], len(text)
        while end > 0:
            out.append(last[end])
            end -= size[last[end]]
        return out[::-1]

    def _word(self, word: str) -> list[int]:
        """Ids of a text without runs of U+2581; unknown characters become bytes."""
        if self.known.issuperset(word):
            return [self.piece_id[k] for k in self._known_run(word)]
        out: list[int] = []
        for part in re.split(f"({self.unknown}+)", word):
            if part and part[0] not in self.known:
                out += [self.byte_id[b] for b in part.encode()]
            elif part:
                out += [self.piece_id[k] for k in self._known_run(part)]
        return out

    def _unit(self, unit: str) -> tuple[int, ...]:
        word = unit.lstrip(" ")
        spaces = len(unit) - len(word)
        if not spaces:
            return tuple(self._word(word))
        ids = self._word(SPACE + word)
        if ids[0] == self.ids.get(SPACE):
            ids, spaces = ids[1:], spaces + 1
        run = self.merge(SPACE * (spaces - 1)) if spaces > 1 else []
        return tuple([self.ids[p] for p in run] + ids)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            cache = self.cache
            for unit in self.unit.findall(" " + text.replace(SPACE, " ")):
                ids = cache.get(unit)
                if ids is None:
                    if (ids := self.older.get(unit)) is None:
                        ids = self._unit(unit)
                    if len(unit) < 64:
                        if len(cache) >= CACHE:
                            self.older, self.cache = cache, {}
                            cache = self.cache
                        cache[unit] = ids
                out.extend(ids)
        out.append(self.eos)
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids): the added prefix, a space that leads the first piece, goes."""
        body = ids[:-1] if ids and ids[-1] in self.control else ids
        runs = [body]
        for c in self.control:  # a control id ends a run of byte pieces
            if c in body:
                runs = [r for run in runs for r in _split(run, c)]
        text = "".join(b"".join(map(self.surface.__getitem__, r)).decode("utf-8", "quarry-each-byte") for r in runs)
        first = next((i for i in ids if self.surface[i]), None)
        return text[1:] if text[:1] == " " and first not in self.raw else text


_LOADED: dict[str, PrefixTableBPE] = {}


def loaded(model_file: str) -> PrefixTableBPE:
    """One encoder per worker process and model file."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PrefixTableBPE(model_file)
    return _LOADED[model_file]


def results(bpe: PrefixTableBPE, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """One result a text, ``AT_ONCE`` at a time: a batch's ids and decoded texts are several times its size."""
    for batch in batches:
        for start in range(0, len(batch), AT_ONCE):
            flat: list[int] = []
            ends, decoded = [0], []
            for text in batch.slice(start, AT_ONCE):
                flat += (ids := bpe.encode(text.as_py()))
                ends.append(len(flat))
                decoded.append(bpe.decode(ids))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], ["ids", "decoded"])


def encode_decode(text: Column, model_file: str) -> Column:
    """Column struct(ids array<int>, decoded string) of a text column.

    ``model_file`` is read on the executors, where the tokenizer package is installed."""

    @F.arrow_udf(RESULT)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from results(loaded(model_file), batches)

    return apply(text)


def encode_documents(docs: DataFrame, model_file: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``ids`` (array<int>, the end id last) and ``decoded``."""
    both = docs.select(*[col(c) for c in keep], encode_decode(col(text_col), model_file).alias("_enc"))
    return both.select(*[col(c) for c in keep], F.col("_enc.ids").alias("ids"), F.col("_enc.decoded").alias("decoded"))
