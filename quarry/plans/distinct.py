"""Exact distinct counts of many columns without moving their cells.

Every cell becomes a whole number that only equal cells share, and the numbers are kept as a bitmap of
words: ``(column, kind, number >> 6)`` is a word's address, and a cell sets the bit of its last six bits.
Words are combined map-side (``bit_or``, inside generated code), so up to 64 neighbouring values travel as
one row of three numbers, and a value without neighbours as one such row too.

The kinds of numbers:

* ``EXACT``: whole numbers, days, booleans, units of decimals up to 18 digits; doubles that are a count of cents, as that count; times at
  midnight, as days.  Dense columns (keys, dates, prices) fill their words.
* ``BITS``: every other cell of at most eight bytes, by a 64-bit hash that is one-to-one on such cells.
* Texts, binaries, wide decimals, arrays and structs have a 64-bit hash of their own, with the smallest and
  largest of a second one beside it.  A hash whose second ones differ stands for several values: those are
  counted in full in a second look.  Two values are taken as one only if all 128 bits agree, which for 1e12
  distinct values of a column has a chance of 1e-15.

NULLs don't count; NaN is one value, and so is -0.0 with 0.0.  Nothing is sampled or estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_float, q
from .guards import bounded_broadcast, cut_lineage

EXACT, BITS = 0, 1
CENTS = 1e13  # up to here a count of cents and the double it comes from determine each other

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _narrow(dt: T.DataType) -> bool:
    return isinstance(dt, (*_WHOLE, *_TIMES, T.DateType)) or is_float(dt) or isinstance(dt, T.DecimalType) and dt.precision <= 18


def _number(c: Column, dt: T.DataType) -> tuple[Column, Column]:
    """The kind and number of a cell of at most eight bytes; the number is NULL where the cell is."""
    if isinstance(dt, _WHOLE):
        return F.lit(EXACT), c.cast("long")
    if isinstance(dt, T.DateType):
        return F.lit(EXACT), F.unix_date(c).cast("long")
    if isinstance(dt, _TIMES):
        day = c.cast("date")
        plain, number = day.cast(dt) == c, F.unix_date(day).cast("long")
    elif is_float(dt):
        x = c.cast("double")
        cents = F.when(F.abs(x) < CENTS, F.rint(x * 100.0))
        plain, number = cents / 100.0 == x, cents.cast("long")
    else:  # a decimal's units
        return F.lit(EXACT), (c * F.lit(Decimal(10) ** dt.scale)).cast("long")
    return F.when(plain, EXACT).otherwise(BITS), F.when(plain, number).when(c.isNotNull(), F.xxhash64(c))


def _text(c: Column, dt: T.DataType) -> Column:
    return c if isinstance(dt, (T.StringType, T.BinaryType)) else c.cast("string")


def two_hashes(cell: Column) -> tuple[Column, Column]:
    return F.xxhash64(cell), F.xxhash64(F.lit(1), cell)


def distinct_counts(df: DataFrame, cols: Sequence[str], hashes: Callable[[Column], tuple[Column, Column]] = two_hashes) -> dict[str, int]:
    """Distinct non-NULL values of each of ``cols``: one scan and shuffle for narrow columns, one for the others."""
    types = {c: df.schema[c].dataType for c in cols}
    found = dict.fromkeys(cols, 0)
    narrow = [c for c in cols if _narrow(types[c])]
    wide = [c for c in cols if c not in narrow]
    for c, n in _by_words(df, narrow).items():
        found[c] = n
    for c, n in _by_hashes(df, wide, types, hashes).items():
        found[c] = n
    return found


def words(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The bitmap of narrow columns: ``slot`` (twice the column's position, and one more for ``BITS``), ``at``, ``word``."""
    cells = []
    for i, c in enumerate(cols):
        kind, number = _number(q(c), df.schema[c].dataType)
        cells.append(F.struct((F.lit(2 * i) + kind).cast("int").alias("slot"), number.alias("number")))
    # bitwise: the last six bits choose the bit, whatever the sign
    bit = F.expr("shiftleft(1L, cast(number & 63 as int))")
    return df.select(F.inline(F.array(*cells))).where("number IS NOT NULL").groupBy("slot", F.shiftright("number", 6).alias("at")).agg(F.bit_or(bit).alias("word"))


def _by_words(df: DataFrame, cols: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    if cols:
        for slot, n in words(df, cols).groupBy("slot").agg(F.sum(F.bit_count("word"))).collect():  # at most two rows a column
            out[cols[slot // 2]] = out.get(cols[slot // 2], 0) + n
    return out


def _by_hashes(df: DataFrame, cols: list[str], types: dict, hashes) -> dict[str, int]:
    if not cols:
        return {}
    cells = []
    for i, c in enumerate(cols):
        cell = _text(q(c), types[c])
        a, b = hashes(cell)
        cells.append(F.struct(F.lit(i).alias("slot"), cell.isNotNull().alias("there"), a.alias("a"), b.alias("b")))
    groups = df.select(F.inline(F.array(*cells))).where("there").groupBy("slot", "a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    counts = groups.groupBy("slot").agg(F.count_if(F.col("lo") == F.col("hi")).alias("n"), F.count_if(F.col("lo") != F.col("hi")).alias("shared")).collect()
    out = {cols[r.slot]: r.n for r in counts}
    again = [r.slot for r in counts if r.shared]
    if again:
        shared = cut_lineage(groups.where(F.col("lo") != F.col("hi")).select("slot", "a"))
        for i in again:
            cell = _text(q(cols[i]), types[cols[i]])
            side = bounded_broadcast(shared.where(F.col("slot") == i).select("a"))
            values = df.select(hashes(cell)[0].alias("a"), cell.alias("v")).where("v IS NOT NULL").join(side, "a", "left_semi")
            out[cols[i]] += values.select("v").distinct().count()
    return out
