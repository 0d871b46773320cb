"""Exact quantiles (pandas ``linear`` interpolation) without one giant aggregation buffer.

Spark's ``percentile`` keeps a map of every distinct value in one aggregation buffer, and a global
aggregate merges all of them into one task.  This module finds the values at the target ranks of a
*long* table ``(key..., v)`` by counting, the same way at every size:

1. Values fall into intervals by sign and binary exponent; one ``groupBy(key, interval)`` gives each
   interval's count, smallest and largest value (partial aggregation, a few thousand groups a key).
2. Running counts place each target rank in its interval.  An interval of a single value is done.
3. While an open interval holds more than ``limit`` rows, the rows of the open intervals (found by an
   equi-join on key and interval path) fall into ``PARTS`` equal slices between its smallest and
   largest value, and are counted again.  Values of one interval share their exponent, so a slice
   settles 12 of at most 52 bits: at most six counts in all, two or three as a rule.
4. Inside the last open intervals the distinct values are counted and ranked.

Each round costs one count a row; nothing depends on a sample, and no aggregate grows with the
number of ranks.  Interval tables are checkpointed between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_float, q
from ..functions.exprs import double_array
from .guards import bounded_broadcast, cut_lineage, spread

LIMIT = 20_000  # rows of an interval whose distinct values are ranked
PARTS = 4096  # slices of an interval


def long_format(df: DataFrame, cols: Sequence[str], key: str = "key", value: str = "v") -> DataFrame:
    """Unpivot numeric columns to ``(key, v)`` rows, dropping NULLs and NaN."""
    structs = [F.struct(F.lit(c).alias(key), q(c).cast("double").alias(value)) for c in cols]
    return df.select(F.inline(F.array(*structs))).where(F.col(value).isNotNull() & ~F.isnan(value))


def _lerp(v0: Column, v1: Column, frac: Column) -> Column:
    """numpy's linear interpolation (lerp from the nearer end); at a value and between equal ones that value, infinite ones too."""
    diff = v1 - v0
    return F.when((frac == 0) | (v0 == v1), v0).when(frac >= 0.5, v1 - diff * (1 - frac)).otherwise(v0 + diff * frac)


def _prob_grid(probs: Sequence[float]) -> Column:
    """Array of (pi, p) structs.  An evenly spaced grid j / (m - 1) is generated from a sequence
    (same IEEE division as Python), so a 1000-knot fit does not put 1000 literals in the plan."""
    m = len(probs)
    if m > 16 and all(p == j / (m - 1) for j, p in enumerate(probs)):
        return F.transform(F.sequence(F.lit(0), F.lit(m - 1)),
                           lambda j: F.struct(j.alias("pi"), (j.cast("double") / F.lit(float(m - 1))).alias("p")))
    return F.array(*[F.struct(F.lit(i).alias("pi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])


def _exponent(v: Column) -> Column:
    """Interval by sign and binary exponent; never decreasing in v."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    infinite = F.abs(v) == float("inf")
    return (F.when(v == 0, F.lit(0)).when(infinite, F.signum(v).cast("int") * 5000)
            .when(v > 0, size).otherwise(-size))


def _slice(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.floor((v - lo) / (hi - lo) * PARTS).cast("int"), F.lit(PARTS - 1))


def _place(runs: DataFrame, ranks: DataFrame, part: list[str], order: str) -> DataFrame:
    """For each rank (part..., rank, rel) the last run (part..., order, c, lo, hi) that starts at or before rel.

    ``rel`` becomes the rank within that run."""
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("pos", F.coalesce(F.sum("c").over(before), F.lit(0)).cast("long"))
    run = F.struct(F.col(order).alias("at"), "pos", "c", "lo", "hi")
    kind = runs.select(run.alias("run")).schema["run"].dataType
    both = runs.select(*part, "pos", F.lit(0).alias("kind"), run.alias("run"), F.lit(None).cast("long").alias("rank")).unionByName(
        ranks.select(*part, F.col("rel").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("run"), "rank"))
    upto = Window.partitionBy(*part).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = both.withColumn("run", F.last("run", ignorenulls=True).over(upto)).where("kind = 1")
    return hit.select(*part, "rank", (F.col("pos") - F.col("run.pos")).alias("rel"), F.col("run.at").alias(order), "run.c", "run.lo", "run.hi")


def _within(rows: DataFrame, intervals: DataFrame, part: list[str]) -> DataFrame:
    """The rows that lie in one of the intervals, with its lo and hi."""
    iv = bounded_broadcast(intervals.select(*[F.col(c).alias(f"_{c}") for c in part], "lo", "hi"))
    cond = F.lit(True)
    for c in part:  # plain equality where there can be no NULL hashes half as many columns
        cond = cond & (rows[c].eqNullSafe(iv[f"_{c}"]) if c.startswith("_k") and rows.schema[c].nullable else rows[c] == iv[f"_{c}"])
    return rows.join(iv, cond).drop(*[f"_{c}" for c in part])


def exact_quantiles(long: DataFrame, probs: Sequence[float], keys: Sequence[str] = ("key",), value: str = "v", limit: int = LIMIT) -> DataFrame:
    """``(keys..., pi, p, n, q)``: pandas-linear quantiles of ``value`` per key."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = long.select(*[q(k).alias(n) for k, n in zip(keys, names)], q(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    part, bucket, v = list(names), _exponent(F.col("_v")), F.col("_v")
    found: list[DataFrame] = []
    targets = ranks = None
    for depth in range(8):
        rows = rows.withColumn(f"_b{depth}", bucket).drop("lo", "hi")
        runs = rows.groupBy(*part, f"_b{depth}").agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        if targets is None:
            runs = cut_lineage(runs)
            n = runs.groupBy(*names).agg(F.sum("c").alias("n"))
            targets = n.select(*names, "n", F.inline(_prob_grid(probs))).withColumn("h", (F.col("n") - 1) * F.col("p"))
            targets = targets.withColumn("r0", F.floor("h").cast("long"))
            ranks = targets.select(*names, F.explode(F.array("r0", F.least(F.col("r0") + 1, F.col("n") - 1))).alias("rank")).distinct()
            ranks = ranks.withColumn("rel", F.col("rank"))
        hit = cut_lineage(_place(runs, ranks, part, f"_b{depth}"))
        found.append(hit.where("lo = hi").select(*names, "rank", F.col("lo").alias("val")))
        part.append(f"_b{depth}")
        open_ = hit.where("lo < hi")
        largest = open_.agg(F.max("c")).first()[0]
        if largest is None:
            break
        rows = _within(rows, open_.select(*part, "lo", "hi").distinct(), part)
        ranks = open_.select(*part, "rank", "rel")
        if largest <= limit:
            runs = rows.groupBy(*part, "_v").agg(F.count("*").alias("c")).withColumns({"lo": v, "hi": v})
            found.append(_place(runs, ranks, part, "_v").select(*names, "rank", F.col("lo").alias("val")))
            break
        bucket = _slice(v, F.col("lo"), F.col("hi"))
    at = found[0]
    for more in found[1:]:
        at = at.unionByName(more)
    frac = F.col("h") - F.col("r0")
    sides = targets.select("*", F.posexplode(F.array("r0", F.least(F.col("r0") + 1, F.col("n") - 1))).alias("side", "rank"))
    ranked = at.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("rank").alias("_rank"), "val")
    cond = sides["rank"] == ranked["_rank"]
    for n in names:
        cond = cond & sides[n].eqNullSafe(ranked[f"_{n}"])
    both = sides.join(ranked, cond).groupBy(*names, "pi", "p", "n", "h", "r0").agg(
        F.max(F.when(F.col("side") == 0, F.col("val"))).alias("v0"), F.max(F.when(F.col("side") == 1, F.col("val"))).alias("v1"))
    return both.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "pi", "p", "n", _lerp(F.col("v0"), F.col("v1"), frac).alias("q"))


def approx_quantiles(
    long: DataFrame, probs: Sequence[float], keys: Sequence[str] = ("key",), value: str = "v", accuracy: int = 10_000
) -> DataFrame:
    """One-pass sketch quantiles (opt-in: results are approximate)."""
    keys = list(keys)
    agg = long.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.percentile_approx(value, [float(p) for p in probs], accuracy).alias("qs"),
    )
    return agg.select(*keys, "n", F.posexplode("qs").alias("pi", "q")).withColumn(
        "p", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("pi") + 1)
    ).select(*keys, "pi", "p", "n", "q")


def quantiles(long: DataFrame, probs: Sequence[float], keys=("key",), value="v", method: str = "exact") -> DataFrame:
    if method == "approx":
        return approx_quantiles(long, probs, keys, value)
    return exact_quantiles(long, probs, keys, value)


FINE = 512  # slices of a binary exponent in the first count of whole columns


def _fine(v: Column) -> Column:
    """Interval by sign, binary exponent and ``FINE`` slices of it; never decreasing in v."""
    exponent = F.floor(F.log2(F.abs(v)))
    part = F.greatest(F.least(F.floor((F.abs(v) / F.pow(F.lit(2.0), exponent) - 1) * FINE), F.lit(FINE - 1)), F.lit(0))
    size = ((exponent + 1100) * FINE + part + 1).cast("int")
    return (F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v).cast("int") * (5000 * FINE))
            .when(v > 0, size).otherwise(-size))


def place_in(x: Column, starts: Column, n: int) -> Column:
    """Place of the last of the ``n`` rising ``starts`` at or below ``x`` (0 where there is none), by binary search."""
    step = 1 << (max(n, 1).bit_length() - 1)
    widths = F.array(*[F.lit(step >> b) for b in range(step.bit_length())])

    def further(at: Column, width: Column) -> Column:
        return F.when((at + width < n) & (F.get(starts, at + width) <= x), at + width).otherwise(at)

    return F.aggregate(widths, F.lit(0), further)


def _column_value(df: DataFrame, c: str) -> Column:
    v = q(c).cast("double")
    return F.when(~F.isnan(v), v) if is_float(df.schema[c].dataType) else v


def _open_rows(df: DataFrame, open_: dict[str, list[tuple]], order: dict[str, int]) -> DataFrame:
    """``key, at, lo, hi, v``: values that lie in one of their column's open intervals (disjoint, rising)."""
    cells = []
    for c, intervals in open_.items():
        v, starts = _column_value(df, c), double_array(lo for lo, _ in intervals)
        at = place_in(v, starts, len(intervals))
        lo, hi = F.get(starts, at), F.get(double_array(hi for _, hi in intervals), at)
        cells.append(F.struct(F.lit(order[c]).alias("key"), at.alias("at"), lo.alias("lo"), hi.alias("hi"), v.alias("v")))
    return df.select(F.inline(F.array(*cells))).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _values_at(inside_of: Callable[[dict[str, list[tuple]]], DataFrame], ranks: dict[str, list[int]], runs: DataFrame, limit: int,
               size: Column | None = None) -> dict[str, dict[int, float]]:
    """{column: {rank: value}}; ``runs`` (key, b, c, lo, hi) are the first counts of the columns, in the order of ``ranks``.

    ``inside_of`` gives the rows (key, at, lo, hi, v) of open intervals; ``size`` counts rows, where one may stand for several."""
    spark, order = runs.sparkSession, {c: i for i, c in enumerate(ranks)}
    size = F.count("*") if size is None else size
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    wanted = [(order[c], 0, r, r) for c, rs in ranks.items() for r in rs]
    runs = runs.withColumn("at", F.lit(0))
    while wanted:
        asked = spark.createDataFrame(wanted, "key int, at int, rank long, rel long")
        inside: dict[str, dict[tuple, list]] = {}
        for r in _place(runs, asked, ["key", "at"], "b").collect():  # columns x ranks
            c = list(ranks)[r["key"]]
            if r["lo"] == r["hi"]:
                found[c][r["rank"]] = r["lo"]
            else:
                inside.setdefault(c, {}).setdefault((r["lo"], r["hi"]), []).append(r)
        open_ = {c: sorted(of) for c, of in inside.items()}
        wanted = [(order[c], at, r["rank"], r["rel"]) for c, of in open_.items() for at, key in enumerate(of) for r in inside[c][key]]
        if wanted:
            rows, v = inside_of(open_), F.col("v")
            if max(r["c"] for of in inside.values() for rs in of.values() for r in rs) <= limit:
                runs = rows.groupBy("key", "at", v.alias("b")).agg(size.alias("c")).withColumns({"lo": F.col("b"), "hi": F.col("b")})
            else:
                runs = rows.groupBy("key", "at", _slice(v, F.col("lo"), F.col("hi")).alias("b")).agg(
                    size.alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return found


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] | dict[str, Sequence[float]], method: str = "exact", limit: int = LIMIT) -> dict:
    """{column: [q(p) for p in probs]}, NULL and NaN left out, None without values; ``probs`` may differ by column.

    The keys are columns here, so what is asked (columns x probs) fits the driver, and open intervals go
    into the scans as literals: one count of all columns by sign, exponent and slice, then one of the
    values in open intervals (more only while an interval holds more than ``limit`` rows)."""
    cols = list(dict.fromkeys(cols))
    of = probs if isinstance(probs, dict) else dict.fromkeys(cols, probs)
    out: dict[str, list] = {c: [None] * len(of[c]) for c in cols}
    if not cols:
        return out
    if method == "approx":
        every = sorted({p for c in cols for p in of[c]})
        for r in approx_quantiles(long_format(df, cols), every).collect():
            for k, p in enumerate(of[r["key"]]):
                if p == every[r["pi"]]:
                    out[r["key"]][k] = r["q"]
        return out
    df = spread(df.select(*[q(c) for c in cols]))
    cells = [F.struct(F.lit(i).alias("key"), _column_value(df, c).alias("v")) for i, c in enumerate(cols)]
    rows = df.select(F.inline(F.array(*cells))).where("v IS NOT NULL")
    runs = cut_lineage(rows.groupBy("key", _fine(F.col("v")).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    n = {cols[r["key"]]: r["n"] for r in runs.groupBy("key").agg(F.sum("c").alias("n")).collect()}
    at = {c: [(math.floor((n[c] - 1) * p), (n[c] - 1) * p) for p in of[c]] for c in cols if c in n}
    ranks = {c: sorted({x for r, _ in at.get(c, []) for x in (r, min(r + 1, n[c] - 1))}) for c in cols}
    order = {c: i for i, c in enumerate(ranks)}
    found = _values_at(lambda open_: _open_rows(df, open_, order), ranks, runs, limit)
    for c, places in at.items():
        for k, (r, h) in enumerate(places):
            out[c][k] = _lerp_value(found[c][r], found[c][min(r + 1, n[c] - 1)], h - r)
    return out


def _lerp_value(v0: float, v1: float, frac: float) -> float:
    """``_lerp`` of two numbers."""
    if frac == 0 or v0 == v1:
        return v0
    diff = v1 - v0
    return v1 - diff * (1 - frac) if frac >= 0.5 else v0 + diff * frac
