"""Look-ups in a dictionary of any size, whatever share of the rows one key holds.

A dictionary within the broadcast bound is broadcast.  Beyond it a shuffle join would send all rows of
a frequent key to one task, so the rows are split:

* keys that hold more than ``1 / HEAVY`` of the rows are known from a counted first pass (``counted``;
  the dictionaries of the encoders come with their counts anyway).  There are fewer than ``HEAVY`` of
  them, so their dictionary rows are broadcast, and rows of those keys stay where they are;
* rows without a key stay too: they match nothing;
* all other rows are shuffled by key, and no key is large there.

The two parts are put together by a union.  The table is read once for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import positional
from .guards import BROADCAST_BYTES, measured_bytes

#: A key is frequent beyond this part of the rows: well under a task's share in jobs of a few hundred tasks.
HEAVY = 4096


def counted(df: DataFrame, key: Column) -> DataFrame:
    """``value, n``: the distinct non-NULL keys with their rows (map-side combined)."""
    return df.select(key.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, share: int = HEAVY) -> DataFrame:
    """The values of more than ``1 / share`` of the counted rows: fewer than ``share``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * share > total).select("value")


class Lookup:
    """A dictionary ``value -> columns`` (one row a value), ready to be joined to any table.

    ``counts`` (``value, n``) says how many rows of the fitted table each value has."""

    def __init__(self, dictionary: DataFrame, counts: DataFrame, max_bytes: int = BROADCAST_BYTES, share: int = HEAVY):
        self.dictionary = dictionary
        self.columns = [c for c in dictionary.columns if c != "value"]
        self.small = measured_bytes(dictionary) <= max_bytes
        self.heavy = None if self.small else dictionary.join(F.broadcast(frequent(counts, share)), "value", "left_semi")

    def join(self, df: DataFrame, key: Column) -> DataFrame:
        """``df`` with the dictionary's columns, NULL where the key has no entry; ``key`` is an expression over ``df``.

        Returns the columns of ``df`` by position (``c0, c1, ...``), then the dictionary's by name."""
        keyed = df.withColumn("\0key", key)
        rows, _ = positional(keyed)
        key = rows[rows.columns[-1]]
        names = rows.columns[:-1]

        def found(part: DataFrame, side: DataFrame, how: str) -> DataFrame:
            return part.join(side, key == F.col("value"), how).select(*names, *self.columns)

        if self.small:
            return found(rows, F.broadcast(self.dictionary), "left")
        heavy = F.broadcast(self.heavy)
        stays = found(rows.where(key.isNotNull()), heavy, "inner").unionByName(
            rows.where(key.isNull()).select(*names, *[F.lit(None).cast(self.dictionary.schema[c].dataType).alias(c) for c in self.columns]))
        others = rows.where(key.isNotNull()).join(heavy.select("value"), key == F.col("value"), "left_anti")
        light = self.dictionary.join(heavy.select("value"), "value", "left_anti")
        return stays.unionByName(found(others, light, "left"))
