"""Order-dependent operators without a single-partition window.

``Window.orderBy`` with no partition moves every row to one task.  Instead:

1. A sample of the order key (about ``SAMPLE_PER_BUCKET`` rows a bucket) is sorted and numbered by
   Spark; the keys at even steps are the cuts between buckets.  They are checkpointed, so re-evaluation
   cannot move them, and stay a table: a directory of nodes of at most ``FAN`` - 1 cuts, like a B-tree.
   The root's cuts enter the plan as one scalar subquery; a deeper level is found by an equi-join on
   the node (broadcast where it measures small), so no array of all cuts exists anywhere.
2. ``bucket`` = number of cuts below the key, one digit a level, each by binary search in a node.
   Buckets are contiguous ranges of the order, so a duplicate-heavy key is split by its tie-break
   columns.  There are as many buckets as rows ask for, without a ceiling.
3. Each bucket is windowed on its own.  What passes between buckets (rows before, last non-NULL value,
   largest key) is a row per bucket and group; it is carried digit by digit too, at most ``FAN``
   siblings at a time, and joined back.

Splits and pages move no payload: the key at a rank is found on the key columns alone, and rows are
compared with it.  Inside, user columns are named by position, so no name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import free_names, positional, q
from .guards import bounded_broadcast, cut_lineage

ROWS_PER_BUCKET = 1_000_000
SAMPLE_PER_BUCKET = 64
BUCKET = "_bk"
#: Children of a directory node: a power of two.
FAN = 256
_BITS = FAN.bit_length() - 1


def _key(order_cols: Sequence[str]) -> Column:
    """The order key as one struct with helper field names (any column name works)."""
    return F.struct(*[q(c).alias(f"k{i}") for i, c in enumerate(order_cols)])


def _directory(df: DataFrame, order_cols: Sequence[str], n: int, want: int, seed: int) -> DataFrame:
    """``level, node, cuts``: the ``want`` - 1 keys that cut the order into even ranges, as a directory.

    Cut number j = 1, 2, ... is a multiple of FAN ** level and of no higher power; it belongs to the node
    j // FAN ** (level + 1) of that level."""
    keys = df.select(_key(order_cols).alias("b"))
    sample = cut_lineage(keys.sample(False, min(1.0, want * SAMPLE_PER_BUCKET / max(n, 1)), seed).sort("b")
                         .select("b", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")))
    # place in the sorted sample: partitions are in order, ids rise within each
    parts = sample.groupBy("p").agg(F.count("*").alias("c"), F.min("i").alias("first"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the sample
    parts = parts.withColumn("off", F.coalesce(F.sum("c").over(before), F.lit(0)))
    m = sample.count()
    placed = sample.join(bounded_broadcast(parts.select("p", "first", "off")), "p").withColumn("at", F.col("off") + F.col("i") - F.col("first"))
    upto = [F.floor((F.col("at") + more) * want / max(m, 1)).cast("long") for more in (0, 1)]
    cuts = placed.where(upto[1] > upto[0]).select("b", F.explode(F.sequence(upto[0] + 1, upto[1])).alias("j")).where(F.col("j") < want)
    level = F.lit(0)
    for up in range(1, _levels(want)):
        level = F.when(F.col("j") % (FAN**up) == 0, up).otherwise(level)
    node = F.col("j")
    for up in range(_levels(want)):
        node = F.when(F.col("level") == up, F.shiftright("j", _BITS * (up + 1))).otherwise(node)
    nodes = cuts.withColumn("level", level).withColumn("node", node).groupBy("level", "node")
    return nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "b"))), lambda x: x["b"]).alias("cuts"))


def _levels(want: int) -> int:
    """Levels of a directory of ``want`` buckets."""
    return max(1, math.ceil((max(want, 2) - 1).bit_length() / _BITS))


def _below(cuts: Column, key: Column) -> Column:
    """How many of a node's sorted cuts are smaller than ``key``, by binary search."""
    widths = F.array(*[F.lit(1 << b) for b in reversed(range(_BITS))])

    def further(at: Column, width: Column) -> Column:
        return F.when((at + width <= F.size(cuts)) & (F.get(cuts, at + width - 1) < key), at + width).otherwise(at)

    return F.aggregate(widths, F.lit(0), further)


def with_buckets(df: DataFrame, order_cols: Sequence[str], n: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET, seed: int = 7) -> tuple[DataFrame, int]:
    """``df`` with a bucket column for contiguous ranges of ``order_cols`` (ascending, NULLs first), and the number of
    buckets asked for.  No column of ``df`` may have a name that begins with an underscore."""
    n = df.count() if n is None else n
    want = max(1, math.ceil(n / rows_per_bucket))
    if want == 1:
        return df.withColumn(BUCKET, F.lit(0).cast("long")), 1
    levels = _levels(want)
    directory = cut_lineage(_directory(df, order_cols, n, want, seed))
    root = directory.where(F.col("level") == levels - 1).select("cuts")
    key, names = _key(order_cols), df.columns
    out = df.withColumn("_cuts", root.scalar()).withColumn(BUCKET, F.coalesce(_below(F.col("_cuts"), key), F.lit(0)).cast("long"))
    for level in reversed(range(levels - 1)):
        nodes = bounded_broadcast(directory.where(F.col("level") == level).select(F.col("node").alias("_node"), F.col("cuts").alias("_cuts")))
        out = out.select(*names, BUCKET).join(nodes, F.col(BUCKET) == F.col("_node"), "left")
        out = out.withColumn(BUCKET, F.col(BUCKET) * FAN + F.coalesce(_below(F.col("_cuts"), key), F.lit(0)))
    return out.select(*names, BUCKET), want


def _before(buckets: DataFrame, nb: int, part: Sequence[str], values: Sequence[str], kind: str, reverse: bool = False) -> DataFrame:
    """For each row of ``buckets`` (bucket, part..., values...) what the buckets before it (after it, if ``reverse``) have:
    their ``sum``, or their ``last`` non-NULL value.  Returns bucket, part..., and ``_b0, _b1, ...`` for the values.

    Added up digit by digit of the bucket's number, so a window never holds more than FAN siblings of a group."""
    place = F.col(BUCKET)
    of_node = {"sum": F.sum, "last": lambda v: (F.min_by if reverse else F.max_by)(v, F.when(v.isNotNull(), place))}[kind]
    of_earlier = {"sum": F.sum, "last": lambda v: F.last(v, ignorenulls=True)}[kind]
    total = {"sum": lambda near, far: near + F.coalesce(far, F.lit(0)), "last": F.coalesce}[kind]
    start = {"sum": F.lit(0), "last": F.lit(None)}[kind]
    inner, keys = [f"_b{i}" for i in range(len(values))], [f"_on{i}" for i in range(len(part))]
    out = buckets.select(BUCKET, *part, *[start.cast(buckets.schema[v].dataType).alias(b) for v, b in zip(values, inner)])
    for level in range(_levels(nb)):
        node = F.shiftright(BUCKET, _BITS * level)
        sums = buckets.groupBy(node.alias("_node"), *[F.col(p).alias(k) for p, k in zip(part, keys)]).agg(*[of_node(F.col(v)).alias(v) for v in values])
        w = Window.partitionBy(F.shiftright("_node", _BITS), *keys).orderBy(F.col("_node").desc() if reverse else F.col("_node")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("_node", *keys, *[of_earlier(F.col(v)).over(w).alias(f"_far{i}") for i, v in enumerate(values)])
        cond = node == F.col("_node")
        for p, k in zip(part, keys):
            cond = cond & F.col(p).eqNullSafe(F.col(k))
        out = out.join(sums, cond).select(BUCKET, *part, *[total(F.col(b), F.col(f"_far{i}")).alias(b) for i, b in enumerate(inner)])
    return out


def _numbered(df: DataFrame, order: Sequence[str], nb: int) -> DataFrame:
    """Bucketed rows with ``_number``, their 1-based position in the order."""
    local = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*[q(c) for c in order]))
    if nb == 1:
        return df.withColumn("_number", local.cast("long"))
    counts = cut_lineage(df.groupBy(BUCKET).agg(F.count("*").alias("_c")))
    before = bounded_broadcast(_before(counts, nb, [], ["_c"], "sum").withColumnRenamed(BUCKET, "_ob"))
    return df.withColumn("_local", local).join(before, F.col(BUCKET) == F.col("_ob")).withColumn("_number", (F.col("_local") + F.col("_b0")).cast("long"))


def global_row_number(df: DataFrame, order_cols: Sequence[str], name: str = "row_number", **kw) -> DataFrame:
    """1-based position in the total order of ``order_cols`` (make them unique for a deterministic result)."""
    rows, to = positional(df)
    order = [to[c] for c in order_cols]
    d, nb = with_buckets(rows, order, **kw)
    out = _numbered(d, order, nb)
    return out.select(*[F.col(i).alias(c) for c, i in to.items() if c != name], F.col("_number").alias(name))


def _fill(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str], forward: bool,
          **kw) -> DataFrame:
    rows, to = positional(df)
    cols, order, part = [to[c] for c in cols], [to[c] for c in order_by], [to[c] for c in partition_by or []]
    d, nb = with_buckets(rows, part + order, **kw)
    okey = _key(order)
    # backwards the order is reversed, so that both frames grow by one row a step
    by = [q(c) if forward else q(c).desc() for c in order]
    w = Window.partitionBy(BUCKET, *part).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"_l{i}": F.last(q(c), ignorenulls=True).over(w) for i, c in enumerate(cols)})
    filled = {c: F.col(f"_l{i}") for i, c in enumerate(cols)}
    if nb > 1:
        # carried between buckets, per partition group: last (first) non-NULL value of earlier (later) buckets
        pick = F.max_by if forward else F.min_by
        summary = d.groupBy(BUCKET, *part).agg(*[pick(q(c), F.when(q(c).isNotNull(), okey)).alias(f"_s{i}") for i, c in enumerate(cols)])
        summary = cut_lineage(summary)
        carry = _before(summary, nb, part, [f"_s{i}" for i in range(len(cols))], "last", reverse=not forward)
        carry = carry.select(F.col(BUCKET).alias("_cbk"), *[F.col(p).alias(f"_p{p}") for p in part], *[f"_b{i}" for i in range(len(cols))])
        cond = F.col(BUCKET) == F.col("_cbk")
        for p in part:
            cond = cond & F.col(p).eqNullSafe(F.col(f"_p{p}"))
        d = d.join(bounded_broadcast(carry), cond, "left")
        filled = {c: F.coalesce(F.col(f"_l{i}"), F.col(f"_b{i}")) for i, c in enumerate(cols)}
    return d.select(*[filled.get(i, F.col(i)).alias(c) for c, i in to.items()])


def forward_fill(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (), **kw):
    """NULL -> previous non-NULL value in ``order_by`` order (within ``partition_by`` groups)."""
    return _fill(df, cols, order_by, partition_by, True, **kw)


def backward_fill(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (), **kw):
    """NULL -> next non-NULL value in ``order_by`` order (within ``partition_by`` groups)."""
    return _fill(df, cols, order_by, partition_by, False, **kw)


def sorted_gaps(values: DataFrame, col: str, **kw) -> DataFrame:
    """For the distinct non-NULL values of ``col``: (value, _prev) where _prev is the next smaller value."""
    rows, to = positional(values)
    c = to[col]
    d, nb = with_buckets(rows, [c], **kw)
    d = d.withColumn("_prev", F.lag(q(c)).over(Window.partitionBy(BUCKET).orderBy(q(c))))
    if nb > 1:
        largest = cut_lineage(d.groupBy(BUCKET).agg(F.max(q(c)).alias("_mx")))
        carry = _before(largest, nb, [], ["_mx"], "last").withColumnRenamed(BUCKET, "_cbk")
        d = d.join(bounded_broadcast(carry), F.col(BUCKET) == F.col("_cbk"), "left").withColumn("_prev", F.coalesce("_prev", "_b0"))
    return d.select(*[F.col(i).alias(n) for n, i in to.items()], "_prev")


def key_at(df: DataFrame, order_cols: Sequence[str], rank: int, n: int, **kw) -> tuple:
    """(values of ``order_cols`` at the 1-based ``rank``, rows below that key, rows equal to it).

    Only the key columns move; of those, one bucket is sorted."""
    return keys_at(df, order_cols, [rank], n, **kw)[0]


def keys_at(df: DataFrame, order_cols: Sequence[str], ranks: Sequence[int], n: int, **kw) -> list[tuple]:
    """``key_at`` for a few ranks at once: the keys are bucketed and counted once."""
    keys = df.select(*[q(c).alias(f"k{i}") for i, c in enumerate(order_cols)])
    names = keys.columns
    d, nb = with_buckets(keys, names, n=n, **kw)
    runs, asked = d, [(0, 0, r) for r in ranks]
    if nb > 1:
        d = cut_lineage(d)  # the search for the buckets costs most, and two jobs read its result
        counts = cut_lineage(d.groupBy(BUCKET).agg(F.count("*").alias("_c")))
        before = _before(counts, nb, [], ["_c"], "sum").withColumnRenamed(BUCKET, "_ob")
        placed = counts.join(before, F.col(BUCKET) == F.col("_ob"))
        hit = F.lit(False)
        for r in ranks:
            hit = hit | ((F.col("_b0") < r) & (F.col("_b0") + F.col("_c") >= r))
        found = placed.where(hit).collect()  # a bucket a rank
        asked = [next((f[BUCKET], f["_b0"], r) for f in found if f["_b0"] < r <= f["_b0"] + f["_c"]) for r in ranks]
        runs = d.where(F.col(BUCKET).isin([b for b, _, _ in asked]))
    runs = runs.groupBy(BUCKET, *names).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(BUCKET).orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.lit(False)
    for b, _, r in asked:
        off = next(o for x, o, _ in asked if x == b)
        hit = hit | ((F.col(BUCKET) == b) & (F.col("_end") >= r - off) & (F.col("_end") - F.col("_c") < r - off))
    rows = runs.withColumn("_end", F.sum("_c").over(w)).where(hit).collect()  # a row a rank
    out = []
    for b, off, r in asked:
        row = next(x for x in rows if x[BUCKET] == b and x["_end"] - x["_c"] < r - off <= x["_end"])
        out.append((tuple(row[c] for c in names), row["_end"] - row["_c"] + off, row["_c"]))
    return out


def _compare(df: DataFrame, order_cols: Sequence[str], values: tuple) -> tuple[Column, Column]:
    """The key of a row, and the literal key of ``values`` (NULLs first, like the sort)."""
    kinds = [df.schema[c].dataType for c in order_cols]
    return _key(order_cols), F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, kinds))])


def first_rows(df: DataFrame, order_cols: Sequence[str], count: int, flag: str, n: int, **kw) -> DataFrame:
    """``df`` with the boolean ``flag``: whether a row is among the first ``count`` in ``order_cols`` order.

    Rows are compared with the key at that rank, so they don't move.  Only if that key has more rows than
    fit are those rows numbered, in no particular order."""
    if count <= 0 or count >= n:
        return df.withColumn(flag, F.lit(count >= n and n > 0))
    values, below, equal = key_at(df, order_cols, count, n, **kw)
    key, cut = _compare(df, order_cols, values)
    if below + equal == count:
        return df.withColumn(flag, key <= cut)
    tie, pos = free_names([*df.columns, flag], "tie", "pos")
    ties = df.where(key == cut).withColumn(tie, F.xxhash64(*[q(c) for c in df.columns]))
    numbered = global_row_number(ties, [tie], name=pos, n=equal, **kw)
    return df.where(key != cut).withColumn(flag, key < cut).unionByName(
        numbered.withColumn(flag, q(pos) <= count - below).drop(tie, pos))


def page(df: DataFrame, page_no: int = 1, page_size: int = 10, order_by: Sequence[str] | None = None, **kw) -> DataFrame:
    """Rows of one page in ``order_by`` order, with ``total_rows`` and ``total_pages``.

    The keys at the page's first and last rank bound its rows (found together); only those are sorted.
    ``order_by`` must be a unique key for a stable page."""
    order = list(order_by or df.columns)
    n = df.count()
    lo, hi = (page_no - 1) * page_size + 1, min(page_no * page_size, n)
    pages = math.ceil(n / page_size) if page_size else 0
    total = {"total_rows": F.lit(n).cast("long"), "total_pages": F.lit(pages).cast("long")}
    if lo > hi:
        return df.limit(0).withColumn("row_number", F.lit(0).cast("long")).withColumns(total)
    (first, below, _), (last, below_last, equal_last) = keys_at(df, order, [lo, hi], n, **kw)
    key, a = _compare(df, order, first)
    _, b = _compare(df, order, last)
    numbered = global_row_number(df.where((key >= a) & (key <= b)), order, name="row_number", n=below_last + equal_last - below, **kw)
    numbered = numbered.withColumn("row_number", F.col("row_number") + below)
    return numbered.where(F.col("row_number").between(lo, hi)).withColumns(total)
