"""Finding equal rows without moving all rows.

Rows (or keys) get a fingerprint of 128 bits.  Fingerprints are counted, which shuffles 16 bytes a row
after a map-side combine; only rows whose fingerprint occurs more than once are then shuffled and
compared in full, so rows of equal fingerprints that differ stay different.  Rows of other fingerprints
stay where they are.

The repeated fingerprints are joined back by a broadcast within the measured bound, else by a shuffle
join.  Narrow rows (fixed-width columns of ``NARROW`` bytes in all) are cheaper to move than to
fingerprint: callers group them as they are (``worth_it``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import free_name, is_float, q
from .guards import bounded_broadcast, cut_lineage

NARROW = 64
Fingerprint = Callable[[DataFrame, Sequence[str]], Column]


def worth_it(df: DataFrame) -> bool:
    """Whether rows of ``df`` are wider than ``NARROW`` bytes, or of variable width."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return any(not isinstance(f.dataType, fixed) for f in df.schema.fields) or 8 * len(df.columns) > NARROW


def fingerprint(df: DataFrame, cols: Sequence[str]) -> Column:
    """128 bits of the values: equal values (NULL = NULL, -0.0 = 0.0, NaN = NaN) have equal bits."""
    cells = [q(c) + F.lit(0.0) if is_float(df.schema[c].dataType) else q(c) for c in cols]
    gaps = [q(c).isNull() for c in cols]  # a hash passes over NULLs
    return F.struct(F.xxhash64(*cells, *gaps).alias("a"), F.xxhash64(F.lit(1), *gaps, *reversed(cells)).alias("b"))


def parted(df: DataFrame, cols: Sequence[str], mark: Fingerprint = fingerprint) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose ``cols`` occur once, and all rows that may share theirs with another."""
    name = free_name("fingerprint", df.columns)
    marked = df.withColumn(name, mark(df, cols))
    several = cut_lineage(marked.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name))
    side = bounded_broadcast(several)
    return marked.join(side, name, "left_anti").select(*[q(c) for c in df.columns]), marked.join(side, name, "left_semi").select(*[q(c) for c in df.columns])
