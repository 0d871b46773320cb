"""Sums over all pairs of columns in one scan: the blocked cross-product pass.

For columns i and j and the rows where both have a value: their number n, the sums of x_i and x_i**2
(and, at (j, i), of x_j and x_j**2) and of x_i * x_j.  With the missing entries of a row set to 0 and a
0/1 mask beside them, each of these is a matrix product over the rows of a batch, so a partition keeps
four matrices and a table of k columns costs one scan, not one aggregate a pair.

Values are taken less a centre (the column's mean of a first pass), so that sums of squares don't cancel.
A task holds the matrices of k columns (4 * k * k numbers) and ``ROWS`` rows; blocks of ``BLOCK`` columns
leave it one after the other.  Merging them is left to Spark, by pair.  NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_float, q

ROWS = 4096
BLOCK = 64
SCHEMA = "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double"


def centres(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """The columns' means (0 without values or where infinite)."""
    exprs = [F.avg(F.when(~F.isnan(x), x)) for x in (q(c).cast("double") for c in cols)]
    row = df.agg(*[e.alias(f"m{i}") for i, e in enumerate(exprs)]).first()
    return [m if m is not None and np.isfinite(m) else 0.0 for m in row]


def cross_products(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``i, j, n, sx, sy, sxx, syy, sxy`` for the pairs i <= j of ``cols`` with a common row (sums less the centres)."""
    k = len(cols)
    centre = np.array(centres(df, cols))
    rows = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def partial(batches):
        n, sx, sxx, sxy = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])  # NULL becomes NaN
            for lo in range(0, len(x), ROWS):
                z = x[lo : lo + ROWS] - centre
                there = ~np.isnan(z)
                z, there = np.where(there, z, 0.0), there.astype(np.float64)
                n += there.T @ there
                sx += z.T @ there
                sxx += (z * z).T @ there
                sxy += z.T @ z
        for lo in range(0, k, BLOCK):
            i, j = np.nonzero(np.triu(n[lo : lo + BLOCK], lo))
            i = i + lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j].astype(np.int64)), *map(pa.array, (sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]))],
                names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = rows.mapInArrow(partial, SCHEMA).groupBy("i", "j")
    return sums.agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def pearson(sums: DataFrame) -> DataFrame:
    """``i, j, r``: correlation of the pairs; NULL where a column is constant over the common rows or a sum is not finite."""
    n = F.col("n").cast("double")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # a constant column leaves rounding errors of its squares at most
    flat = (vx <= F.col("sxx") * 1e-14) | (vy <= F.col("syy") * 1e-14)
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.least(cov / F.sqrt(F.abs(vx)) / F.sqrt(F.abs(vy)), F.lit(1.0)), F.lit(-1.0)))
    r = F.when((n > 1) & ~flat & ~F.isnan(vx + vy + cov) & (F.abs(vx + vy + cov) < float("inf")), r)
    return sums.select("i", "j", r.alias("r"))
