"""Operator 13: shards of near equal bytes by sampled splitters (DataFrame functions only).

Rows are put in the order of a key: 60 bits of the text's digest, then the id.  Equal texts stand next
to each other, and apart from that a shard is a random mix of the documents.

1. *Samples.*  A row is drawn with a chance in proportion to its size, ``SAMPLES`` for each splitter.
2. *Splitters.*  The keys at equal shares of the drawn sizes cut the key range; each row finds its range
   by binary search among at most ``FAN`` splitters.
3. *Subdivision.*  The ranges are counted over all rows.  Those of more than ``max_rows`` are sampled anew
   and cut the same way, until none is left; a key ends in the row's own number, so copies of one text
   and even equal rows can be cut.  Deeper ranges look up their splitters by a join on the range.
4. *Placing.*  Sizes and rows before each range are added up level by level (at most ``FAN`` siblings at
   a time), inside a range by a running sum.  A row whose preceding bytes are b of B lies in shard
   ``b * shards div B``; its slot is the number of rows before it in its shard.

So no shard's bytes differ from an equal share by more than the largest row, whatever was sampled: the
samples only decide how the work is cut.  Shards and slots depend on the rows alone.  Texts are read
once and don't move; what is written and shuffled is the key, the size and the checksum of each row.

Edge cases: a NULL text has 0 bytes (size 8) and the checksum of an empty one.  NULL ids come first in
a text's copies.  Repeated rows each get a slot of their own.  A row larger than a shard leaves others
empty.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, col, written

#: Splitters of a range, one less than its parts: a power of two, so that a level is a digit of the range's number.
FAN = 256
#: Rows drawn for each splitter.
SAMPLES = 32
MAX_ROWS = 1 << 20
#: Ranges before any subdivision, for each shard.
RANGES = 4
#: Levels whose digits fit in a range's number.
LEVELS = 7
OVERHEAD = 8
BROADCAST_BYTES = 8 << 20


def unit_interval(seed: int) -> Column:
    """A number in [0, 1) that depends on the row's number and ``seed`` only."""
    return F.pmod(F.xxhash64("no", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def place_among(splitters: Column, key: Column) -> Column:
    """How many of the sorted ``splitters`` are at most ``key``, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(int(math.log2(FAN))))])

    def step(at: Column, width: Column) -> Column:
        ahead = at + width
        return F.when((ahead <= F.size(splitters)) & (F.get(splitters, ahead - 1) <= key), ahead).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def range_sizes(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("range").agg(F.count("*").alias("rows"), F.sum("bytes").alias("range_bytes")), "shard-ranges")


def splitters_of(rows: DataFrame, overfull: DataFrame, seed: int) -> DataFrame:
    """``range, splitters``: for each range of ``overfull`` (``range, range_bytes, parts``) the sorted keys that cut it.

    Chances are in proportion to size, up to 1; a drawn row stands for the bytes of those not drawn."""
    chance = F.least(F.lit(1.0), F.col("bytes") * F.col("parts") * float(SAMPLES) / F.col("range_bytes"))
    drawn = rows.join(overfull, "range").withColumn("chance", chance).where(unit_interval(seed) < F.col("chance"))
    drawn = drawn.select("range", "parts", "key", (F.col("bytes") / F.col("chance")).alias("weight"))
    whole = Window.partitionBy("range")
    before = F.sum("weight").over(whole.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor(F.coalesce(before, F.lit(0.0)) * F.col("parts") / F.sum("weight").over(whole)).cast("int")
    firsts = drawn.select("range", "key", part.alias("part")).groupBy("range", "part").agg(F.min("key").alias("key")).where("part > 0")
    return firsts.groupBy("range").agg(F.array_sort(F.collect_list("key")).alias("splitters"))


def subdivided(rows: DataFrame, overfull: DataFrame, seed: int) -> DataFrame:
    """``rows`` with one more digit in ``range``: the part of its range that a row's key lies in (0 in the others)."""
    counted = overfull.agg(F.count("*").alias("n"), F.sum("parts").alias("parts")).first()
    cuts = written(splitters_of(rows, broadcast_if(overfull, 24 * counted["n"], BROADCAST_BYTES), seed), "shard-splitters")
    found = rows.join(broadcast_if(cuts, 64 * counted["parts"], BROADCAST_BYTES), "range", "left")
    digit = F.when(F.col("splitters").isNull(), F.lit(0)).otherwise(place_among(F.col("splitters"), F.col("key")))
    return written(found.withColumn("range", F.col("range") * FAN + digit).drop("splitters"), "shard-keys")


def offsets(ranges: DataFrame, levels: int) -> DataFrame:
    """``range, rows_before, bytes_before``, added up digit by digit."""
    out = ranges.select("range", F.lit(0).cast("long").alias("rows_before"), F.lit(0).cast("long").alias("bytes_before"))
    for below in range(levels):
        node = F.shiftright("range", below * (FAN.bit_length() - 1)).alias("node")
        siblings = Window.partitionBy(F.shiftright("node", FAN.bit_length() - 1)).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        sums = ranges.groupBy(node).agg(F.sum("rows").alias("r"), F.sum("range_bytes").alias("b"))
        sums = sums.select("node", F.coalesce(F.sum("r").over(siblings), F.lit(0)).alias("r"), F.coalesce(F.sum("b").over(siblings), F.lit(0)).alias("b"))
        out = out.withColumn("node", node).join(sums, "node").select(
            "range", (F.col("rows_before") + F.col("r")).alias("rows_before"), (F.col("bytes_before") + F.col("b")).alias("bytes_before"))
    return written(out, "shard-offsets")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: its id, ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(col(id_col).alias("id"), text.alias("t")).select(
        "id", (F.octet_length("t") + OVERHEAD).cast("long").alias("bytes"), F.crc32("t").alias("crc"),
        F.conv(F.substring(F.md5("t"), 1, 15), 16, 10).cast("long").alias("digest"), F.monotonically_increasing_id().alias("no"))
    # written once: from here on a row keeps its number, whichever task runs again
    rows = written(keyed.select("bytes", "crc", "no", F.struct("digest", "id", "no").alias("key"), F.lit(0).cast("long").alias("range")), "shard-keys")
    ranges, levels = range_sizes(rows), 0
    parts = F.ceil(F.col("rows") * RANGES / max_rows)
    while levels < LEVELS:
        wanted = F.greatest(parts, F.lit(RANGES * shards)) if levels == 0 else parts
        overfull = ranges if levels == 0 else ranges.where(F.col("rows") > max_rows)
        if overfull.isEmpty():
            break
        rows = subdivided(rows, overfull.select("range", "range_bytes", F.least(wanted, F.lit(FAN)).alias("parts")), levels)
        ranges, levels = range_sizes(rows), levels + 1
    whole = ranges.agg(F.count("*").alias("n"), F.sum("range_bytes").alias("bytes")).first()
    inside = Window.partitionBy("range").orderBy("key")
    placed = rows.select(
        "range", "bytes", "crc", F.col("key.id").alias("id"), (F.row_number().over(inside) - 1).cast("long").alias("nth"),
        F.coalesce(F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = placed.join(broadcast_if(offsets(ranges, levels), 40 * whole["n"], BROADCAST_BYTES), "range")
    placed = placed.withColumn("before", (F.col("bytes_before") + F.col("before")).cast("decimal(20,0)"))
    number = F.expr(f"CAST(before * CAST({shards} AS DECIMAL(10,0)) DIV CAST({whole['bytes'] or 1} AS DECIMAL(20,0)) AS INT)")
    placed = written(placed.select("id", "bytes", "crc", number.alias("shard"), (F.col("rows_before") + F.col("nth")).alias("rank")), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    placed = placed.join(broadcast_if(firsts, 24 * shards, BROADCAST_BYTES), "shard")
    return placed.select(
        F.col("id").alias(id_col), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.col("first")).alias("slot"))
