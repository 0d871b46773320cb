"""Small Column-expression helpers shared by operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles are rounded before leaving an operator that is compared across engines:
# sums differ in the last bits between engines (G8).
DIGITS = 6


def rnd(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c.cast("double"), digits)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole * 100, NULL-safe under ANSI (whole = 0 -> NULL)."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, digits)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, lo: Column, hi: Column) -> Column:
    """clip keeping NULL: Spark greatest/least skip NULLs, so guard the input."""
    return F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")



def double_array(values) -> Column:
    """A literal array of doubles, as one literal in the plan (Python's shortest form reads back exactly)."""
    return F.split(F.lit(" ".join(repr(float(v)) for v in values)), " ").cast("array<double>")
