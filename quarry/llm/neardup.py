"""Operator 6: near duplicates by a chosen-path set similarity join over minwise tokens.

A document is the set of its 5-word shingles (64-bit hashes); documents with a Jaccard similarity
of at least 0.75 are linked, and linked documents form components.

1. Texts of equal sets are one class; only classes are compared.  A class has 64 minwise tokens.
2. ``TREES`` independent trees branch the classes: the children of a node are the classes that
   agree on a selected minwise token.  A pair of similarity 0.75 shares a tree's first node with
   that probability, so 12 trees miss one pair in 16 million.  Where first nodes are large and
   the pair must share children on all four levels too (step 4), a tree reaches it with probability
   0.67 (0.75 times f(4); f(0) = 1, f(k) = 1 - (1 - 0.75 f(k - 1))**2), and 12 trees miss one in 600,000.
3. Nodes of up to ``NODE`` classes are compared exhaustively: first by the tokens (a pair that
   of similarity 0.75 agrees on fewer than ``LIKELY`` of 64 once in 700,000 cases),
   then the classes that have a likely partner by their full sets.  A node returns the links of a
   spanning forest of what it confirmed, so its output never outgrows its members.
4. A larger node (a passage that many documents share, thousands of near copies) first links its
   members to the smallest one, confirmed on full sets.  If that leaves one component, the node is
   done.  Else each member goes on to ``CHILDREN`` children by further selected tokens, up to
   ``DEPTH`` levels; children of one component or one member end.  What is still large then is
   compared in blocks of half a node, the largest component's own blocks among themselves left out.
5. Components come from contraction rounds over the confirmed links.

No node is capped or sampled; a task never holds more than one node of ``NODE``
classes (272 bytes each) or the sets of ``GROUP`` shingles.

Edge cases: a NULL or empty text has an empty set, is linked with nothing and kept.  Fewer than
five words are one shingle.  Rows that share a doc_id are one vertex, even if their texts differ.
A row without doc_id takes part by its text: its component is the smallest doc_id that its text
reaches, and it is kept only if there is none.  Repeated rows are returned as often as they occur.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.splitjoin import Lookup, counted
from .common import broadcast_if, col, written
from .graph import components

SHINGLE = 5
#: Minwise tokens of a class; agreements that a likely pair has at least.
TOKENS, LIKELY = 64, 31
TREES, NODE, CHILDREN, DEPTH = 12, 4096, 2, 4
#: Shingles of the sets that are confirmed together (8 bytes each); larger groups are split into pairs of blocks.
GROUP = 8 << 20
#: Ids of the classes whose sets are needed are broadcast up to this size.
BROADCAST_BYTES = 8 << 20
SIMILARITY = (75, 100)
PROFILE = "struct<n_shingles long, digest binary, tokens array<int>>"

_RNG = np.random.Generator(np.random.PCG64(20))
_WORD_FACTORS = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


# ---------------------------------------------------------------- sets


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    w = (text or "").encode().lower().split()  # bytes: ASCII capitals and ASCII white space only
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(h) >= SHINGLE:
        n = len(h) - SHINGLE + 1
        total = sum(h[i : i + n] * _WORD_FACTORS[i] for i in range(SHINGLE))
    elif len(h):
        total = (h * _WORD_FACTORS[: len(h)]).sum(keepdims=True) + np.uint64(len(h))
    else:
        return h
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)  # spreads the bits, one to one
    total ^= total >> np.uint64(32)
    return np.unique(total)


def minwise(shingles: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for s in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[s : s + 2048, None] * _A + _B).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def profile(text: Column) -> Column:
    """struct(n_shingles, digest of the set, minwise tokens); the latter two NULL for empty sets."""

    @F.arrow_udf(PROFILE)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n, digests, tokens, ends = [], [], [], [0]
            for t in texts:
                s = shingle_set(t.as_py())
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    tokens.append(minwise(s))
                ends.append(len(tokens) * TOKENS)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            yield pa.StructArray.from_arrays([
                pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["n_shingles", "digest", "tokens"])

    return apply(text)


def set_digest(text: Column) -> Column:
    """The digest of ``profile`` alone."""

    @F.arrow_udf("binary")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = (shingle_set(t.as_py()) for t in texts)
            yield pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())

    return apply(text)


def with_sets(docs: DataFrame, needed: DataFrame, rows: int) -> DataFrame:
    """(id, digest, set) of the classes in ``needed`` (id, digest), from ``docs`` (id, text)."""
    some = docs.join(broadcast_if(needed.select("id").distinct(), 8 * rows, BROADCAST_BYTES), "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(made, pa.binary())], ["id", "digest", "set"])

    return some.select("id", "text").mapInArrow(sets, "id long, digest binary, set binary")


# ---------------------------------------------------------------- nodes


def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole nodes from rows sorted by their first column, with the starts of the nodes."""
    rest: list[pa.RecordBatch] = []

    def complete(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        key = table.column(0).to_numpy()
        return table, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # where the last node begins
        if rest and last == 0 and rest[0].column(0)[0].as_py() == key[0]:
            rest.append(batch)  # all of one node, which may go on
            continue
        whole = rest + ([batch.slice(0, last)] if last else [])
        if whole:
            yield complete(pa.Table.from_batches(whole))
        rest = [batch.slice(last)]
    if rest:
        yield complete(pa.Table.from_batches(rest))


def _parts(near: np.ndarray) -> list[list[int]]:
    """Components of two members and more of a symmetric matrix."""
    seen = np.zeros(len(near), bool)
    out = []
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root] = True
        part = [root]
        for i in part:  # grows while it is walked
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            part.extend(new.tolist())
        if len(part) > 1:
            out.append(part)
    return out


def _blocks(members: list[int], n: np.ndarray) -> list[list[int]]:
    """Groups that hold each pair of members, of up to ``GROUP`` shingles (but for a pair of longer texts)."""
    cuts: list[list[int]] = [[]]
    held = 0
    for i in members:
        if cuts[-1] and held + n[i] > GROUP // 2:
            cuts.append([])
            held = 0
        cuts[-1].append(i)
        held += n[i]
    if len(cuts) == 1:
        return cuts
    return [a + b for i, a in enumerate(cuts) for b in cuts[i + 1 :]]


def likely_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, digest, n, tokens) by node -> (group, id, digest) of likely partners.

    Equal groups of different nodes get the same number."""
    for table, starts in whole_nodes(batches):
        ids, n = table.column(1).to_numpy(), table.column(3).to_numpy()
        digests = table.column(2).to_pylist()
        tokens = table.column(4).combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a < 2:
                continue
            t, size = tokens[a:b], n[a:b]
            near = np.empty((b - a, b - a), bool)
            for i in range(0, b - a, 64):
                near[i : i + 64] = (t[i : i + 64, None] == t[None]).sum(axis=2, dtype=np.int16) >= LIKELY
            near &= SIMILARITY[1] * size[:, None] >= SIMILARITY[0] * size
            near &= near.T
            for part in _parts(near):
                own = sorted((a + i for i in part), key=lambda i: (digests[i], ids[i]))
                for group in _blocks(own, n):
                    key = hashlib.blake2b(b"".join(digests[i] for i in group), digest_size=8).digest()
                    out[0].extend([int.from_bytes(key, "big", signed=True)] * len(group))
                    out[1].extend(int(ids[i]) for i in group)
                    out[2].extend(digests[i] for i in group)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["grp", "id", "digest"])


def similar_tree(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets that span the components of all such pairs.

    From each reached set the ones not yet reached are counted through the posting lists of its
    shingles; the lists shed reached sets whenever those are half of them."""
    m = len(sets)
    size = np.array([len(s) for s in sets])

    def similar(both: np.ndarray, i: int, size_j: np.ndarray) -> np.ndarray:
        return SIMILARITY[1] * both >= SIMILARITY[0] * (size[i] + size_j - both)

    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if similar(both, 0, size[1]) else []
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    columns = np.split(column, np.cumsum(size)[:-1])
    order = np.argsort(column, kind="stable")
    owner = np.repeat(np.arange(m), size)[order]
    column = column[order]
    unreached, links = np.ones(m, bool), []
    held = m
    for root in range(m):
        if not unreached[root]:
            continue
        unreached[root] = False
        edge = [root]
        for i in edge:  # grows while it is walked
            left = int(unreached.sum())
            if not left:
                return links
            if left <= held // 2 or held == m:
                stay = unreached[owner]
                owner, column, held = owner[stay], column[stay], left
                starts = np.searchsorted(column, np.arange(len(values) + 1))
            own = columns[i]
            n = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            new = np.flatnonzero(similar(np.bincount(owner[at], minlength=m), i, size) & unreached)
            unreached[new] = False
            edge.extend(new.tolist())
            links.extend((i, j) for j in new.tolist())
    return links


def confirmed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, id, set) -> links (a, b) that span each group's components."""
    for table, starts in whole_nodes(batches):
        ids = table.column(1).to_pylist()
        raw = table.column(2)
        links: list[tuple[int, int]] = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in range(a, b)]
            links.extend((ids[a + i], ids[a + j]) for i, j in similar_tree(sets))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


# ---------------------------------------------------------------- the join


def by_node(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """Runs ``run`` over the rows of each node; nodes are bounded, so no partition can be hot."""
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def links_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Confirmed links within groups (grp, id, digest)."""
    groups = written(groups.distinct(), "neardup-groups")
    needed = written(groups.select("id", "digest").distinct(), "neardup-needed")
    sets = with_sets(docs, needed, needed.count()).dropDuplicates(["id", "digest"])
    rows = groups.join(sets, ["id", "digest"]).select("grp", "id", "set")
    return written(by_node(rows, "grp", confirmed_links, "a long, b long").distinct(), "neardup-links")


def links_of_nodes(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed links within small nodes (key, id, digest)."""
    # a group of near copies meets in most trees: of nodes with equal members one is enough
    member = F.xxhash64("id", "digest")
    same = nodes.groupBy("key").agg(F.sum(F.shiftright(member, 8)).alias("s"), F.bit_xor(member).alias("x"), F.count("*").alias("c"))
    first = same.groupBy("s", "x", "c").agg(F.min("key").alias("key")).select("key")
    rows = nodes.join(first, "key", "left_semi").join(classes, ["id", "digest"])
    groups = by_node(rows.select("key", "id", "digest", "n_shingles", "tokens"), "key", likely_groups, "grp long, id long, digest binary")
    return links_of_groups(docs, groups)


def _token(j: Column) -> Column:
    return F.col("tokens")[j]


def _children(rows: DataFrame, level: int) -> DataFrame:
    picks = [F.pmod(F.xxhash64("key", F.lit(level), F.lit(i)), F.lit(TOKENS)).cast("int") for i in range(CHILDREN)]
    keys = F.array_distinct(F.array(*[F.xxhash64("key", j, _token(j)) for j in picks]))
    return rows.withColumn("key", F.explode(keys))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect what exhaustive comparison would connect.

    ``docs`` (id, text); ``classes`` (id, digest, n_shingles, tokens)."""
    roots = classes.select("id", "digest", F.explode(F.array(*[F.xxhash64(F.lit(t), _token(F.lit(t))) for t in range(TREES)])).alias("key"))
    sizes = written(roots.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "digest")).alias("leader")).where("c > 1"), "neardup-nodes")
    small = roots.join(sizes.where(F.col("c") <= NODE).select("key"), "key", "left_semi")
    found = links_of_nodes(docs, classes, written(small, "neardup-small"))

    large = sizes.where(F.col("c") > NODE)
    if large.isEmpty():
        return found
    rows = written(roots.join(large.select("key", "leader"), "key").join(classes.select("id", "digest", "tokens"), ["id", "digest"]), "neardup-large")
    first = written(large.select("leader").distinct(), "neardup-leaders")
    leaders = first.join(classes.select(F.struct("id", "digest").alias("leader"), F.col("tokens").alias("l_tokens")), "leader")
    leaders = broadcast_if(leaders, first.count() * (TOKENS * 4 + 64), BROADCAST_BYTES)
    pairs = rows.join(leaders, "leader").where("id != leader.id OR digest != leader.digest")
    agree = F.aggregate(F.zip_with("tokens", "l_tokens", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    pairs = pairs.where(agree >= LIKELY).select("id", "digest", "leader").distinct()
    pairs = pairs.withColumn("grp", F.xxhash64("digest", "leader.digest", "id"))
    stars = pairs.select("grp", "id", "digest").unionByName(pairs.select("grp", "leader.id", "leader.digest"))
    found = written(found.unionByName(links_of_groups(docs, stars)).distinct(), "neardup-links")

    of = components(found)
    rows = rows.drop("leader").join(of.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    def open_nodes(rows: DataFrame) -> DataFrame:
        """Sizes of the nodes that hold more than one component."""
        sizes = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"))
        return written(sizes.where("low != high").select("key", "c"), "neardup-open")

    rows = written(rows, "neardup-large")
    sizes = open_nodes(rows)
    for level in range(1, DEPTH + 1):
        if sizes.isEmpty():
            return found
        rows = written(_children(rows.join(sizes.select("key"), "key", "left_semi"), level), "neardup-level")
        sizes = open_nodes(rows)
        few = rows.join(sizes.where(F.col("c") <= NODE).select("key"), "key", "left_semi").select("key", "id", "digest")
        found = found.unionByName(links_of_nodes(docs, classes, written(few, "neardup-small")))
        sizes = sizes.where(F.col("c") > NODE)
    if sizes.isEmpty():
        return found
    return found.unionByName(links_of_nodes(docs, classes, written(in_blocks(rows.join(sizes, "key")), "neardup-blocks")))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Nodes of pairs of blocks that together hold every pair of members of different components.

    ``rows`` (key, c, id, digest, component).  Blocks are numbered by a hash; a node's largest
    component has blocks of its own, whose pairs among themselves are left out."""
    per = written(rows.groupBy("key", "component").agg(F.count("*").alias("n")), "neardup-parts")
    largest = per.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"))
    size = NODE // 4  # a hash fills its blocks unevenly; two of them stay below a node
    at = rows.join(largest, "key")
    main = F.col("component") == F.col("largest")
    blocks = F.ceil(F.col("most") / size), F.ceil((F.col("all") - F.col("most")) / size)
    spread = F.xxhash64("id", "digest", F.lit("block"))
    at = at.withColumns({"main": main, "mains": blocks[0], "others": blocks[1]})
    at = at.withColumn("block", F.pmod(spread, F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    zero = F.lit(0).cast("long")
    other = F.transform(F.sequence(zero, F.col("others") - 1), lambda o: F.when(
        F.col("main"), F.struct(F.lit(True).alias("m"), F.col("block").alias("x"), o.alias("y")))
        .otherwise(F.struct(F.lit(False).alias("m"), F.least("block", o).alias("x"), F.greatest("block", o).alias("y"))))
    own = F.transform(F.sequence(zero, F.col("mains") - 1), lambda m: F.struct(F.lit(True).alias("m"), m.alias("x"), F.col("block").alias("y")))
    pairs = F.when(F.col("main"), other).otherwise(F.concat(other, own))
    return at.withColumn("pair", F.explode(pairs)).select(F.xxhash64("key", "pair.m", "pair.x", "pair.y").alias("key"), "id", "digest")


def classified(texts: DataFrame, own: DataFrame) -> DataFrame:
    """(digest, id, component_id) of the classes of ``own`` (id, n_shingles, digest, tokens); id is the smallest."""
    some = own.where("digest IS NOT NULL")
    classes = some.where("id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "tokens")).alias("m"))
    classes = written(classes.select("m.id", "digest", "m.n_shingles", "m.tokens"), "neardup-classes")
    of = components(links(texts, classes))
    label = classes.select("id", "digest").join(of.withColumnRenamed("v", "id"), "id", "left")
    return written(label.select("digest", "id", F.coalesce("component", "id").alias("component_id")), "neardup-labels")


def profiles(texts: DataFrame) -> DataFrame:
    return written(texts.select("id", profile(F.col("text")).alias("p")).select("id", "p.*"), "neardup-profiles")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept (the component's smallest id)."""
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    own = profiles(texts)
    label = classified(texts, own).select(F.col("digest").alias("value"), "component_id")
    # documents without a set, and those of a text with very many copies, stay where they are
    out = Lookup(label, counted(own, F.col("digest")), BROADCAST_BYTES).join(own.select("id", "n_shingles", "digest"), F.col("digest"))
    out = out.select(F.col("c0").alias("id"), F.col("c1").alias("n_shingles"), F.col("c2").alias("digest"), "component_id")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.when(component.isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, all columns; of a kept row's repetitions one."""
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    own = profiles(texts)
    label = classified(texts, own)
    counts = own.where("digest IS NOT NULL").groupBy("digest", "id").agg(F.count("*").alias("n")).where("n > 1")
    alone = own.groupBy("digest").agg(F.count("*").alias("rows"))
    told = label.join(alone.where("rows > 1").select("digest", "rows"), "digest", "left").where("rows > 1 OR component_id != id")
    again = counts.select("digest", "id", F.lit(True).alias("again"))
    told = written(told.join(again, ["digest", "id"], "left").select(F.col("digest").alias("value"), "component_id", F.coalesce("again", F.lit(False)).alias("again")), "neardup-told")
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, id_ = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    # copies of one text don't meet in a task: frequent digests' rows stay where they are, with their texts
    rows = rows.withColumn("_digest", set_digest(F.col(text)))
    rows = Lookup(told, counted(own, F.col("digest")), BROADCAST_BYTES).join(rows, F.col("_digest")).withColumnRenamed(f"c{len(names)}", "_digest")
    kept = rows.where(F.col("component_id").isNull() | F.col(id_).cast("long").eqNullSafe(F.col("component_id")))
    once = kept.where(F.coalesce("again", F.lit(False)))
    columns = [f"c{i}" for i in range(len(names))]
    once = once.groupBy(F.col(id_).alias("_id"), "_digest").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")).select("r.*")
    return kept.where(~F.coalesce("again", F.lit(False))).select(*columns).unionByName(once).toDF(*names)
