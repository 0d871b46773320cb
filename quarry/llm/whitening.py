"""Operator 11: whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers ``x = floor(64 * c) + 1000000`` (``grid``).  Three passes over the vectors:

1. their number and the sums S of each dimension, exactly;
2. the scatter of ``x - round(S / n)``, exactly (whole numbers, so the order of tasks and retries
   changes nothing), from which n * n * covariance follows in whole numbers and is rounded once;
3. after the fit, the covariance of the whitened vectors, which tells how far they are from white.

The covariance of d dimensions is factored on the driver: Cholesky with the largest pivot first gives
a triangular factor, and one-sided Jacobi rotates pairs of its columns until all are orthogonal.  The
squared norms of the rotated columns are the eigenvalues, the normalised columns the components;
V itself is never multiplied out again, so small eigenvalues keep their digits.

What is bounded by what: the driver and each task hold d x d numbers, whatever the number of rows;
each task emits d * (d + 1) / 2 partial sums.  Vectors are taken in chunks of ``CHUNK`` rows.

Edge cases: vectors that are NULL or hold NULL or non-finite entries get no row.  Vectors of different
lengths are not of one space: the most frequent length counts (ties: the longer), the others hold
missing entries and are dropped like NULL ones.  Entries beyond 9.2e18 / 64 count as that.  Components
of eigenvalue 0 (constant or dependent dimensions, one row, equal rows) can't be scaled and are left
out; without any, rows have empty vectors.  A deviation beyond a long is NULL.  Repeated rows and NULL
ids count and are returned as often as they occur.  An empty table gives an empty result.  Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, written

SCALE, SHIFT = 64, 1_000_000
#: Rows taken at a time; with CHUNK * d * d products below 2**53, float64 products are exact.
CHUNK = 2048
LARGEST = 9.2e18
#: Exact sums travel as high * 2**60 + low.
HALF = 1 << 60
COMPONENTS = 32


@dataclass
class Whitening:
    """A fit: ``n`` vectors with ``sums``, ``components`` as columns by falling ``eigenvalues``, the ``trace`` of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def grid(values: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def chunks(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, row numbers, their entries on the grid)`` of the usable vectors of a batch, ``CHUNK`` rows at a time."""
    vectors = batch.column(at)
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # NULL entries become NaN
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    for size in np.unique(sizes[sizes >= 0]):
        of_size = np.flatnonzero(sizes == size)
        for lo in range(0, len(of_size), CHUNK):
            rows = of_size[lo : lo + CHUNK]
            x = entries[starts[rows][:, None] + np.arange(size)]
            fine = np.isfinite(x).all(axis=1)
            if fine.any():
                yield int(size), rows[fine], grid(x[fine])


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """``x`` in a type in which results up to ``most`` can't overflow."""
    return x if most < 1 << 62 else x.astype(object)


def column_sums(x: np.ndarray) -> np.ndarray:
    return exact(x, len(x) * max(abs(int(x.max())), abs(int(x.min())))).sum(axis=0).astype(object)


def gram(d: np.ndarray) -> np.ndarray:
    """``d.T @ d`` of whole numbers, exactly, as Python integers."""
    most = max(abs(int(d.max())), abs(int(d.min()))) ** 2 * len(d)
    if most < 1 << 53:
        f = d.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    d = exact(d, most)
    return (d.T @ d).astype(object)


def halves(value: int) -> tuple[Decimal, Decimal]:
    return Decimal(value // HALF), Decimal(value % HALF)


def sums_table(rows: list[tuple], keys: list[str]) -> pa.RecordBatch:
    """Partial sums ``(key, ..., value)`` as a batch."""
    parts = [halves(int(r[-1])) for r in rows]
    arrays = [pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(len(keys))]
    arrays += [pa.array([p[k] for p in parts], pa.decimal128(38, 0)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "high", "low"])


def total(row) -> int:
    return int(row["high"]) * HALF + int(row["low"])


def added(partial: DataFrame, *keys: str) -> DataFrame:
    return partial.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def first_moments(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number and per-dimension sums of the vectors of the most frequent length."""

    def fold(batches):
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for size, rows, x in chunks(batch):
                count[size] = count.get(size, 0) + len(rows)
                if size:
                    sums[size] = sums.get(size, 0) + column_sums(x)
        out = [(size, -1, n) for size, n in count.items()]  # place -1: the number of vectors
        out += [(size, k, s) for size, of in sums.items() for k, s in enumerate(of)]
        if out:
            yield sums_table(out, ["size", "place"])

    schema = "size long, place long, high decimal(38,0), low decimal(38,0)"
    sums = written(added(vectors.mapInArrow(fold, schema), "size", "place"), "whitening-sums")
    best = sums.where("place = -1").orderBy(F.desc("high"), F.desc("low"), F.desc("size")).first()
    if best is None:
        return 0, []
    rows = sums.where((F.col("size") == best["size"]) & (F.col("place") >= 0)).collect()
    return total(best), [total(r) for r in sorted(rows, key=lambda r: r["place"])]


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> list[list[Fraction]]:
    """The covariance (divisor n) of the vectors on the grid, exactly."""
    d = len(sums)
    middle = [round(Fraction(s, n)) for s in sums]

    def fold(batches):
        scatter = np.zeros((d, d), dtype=object)
        for batch in batches:
            for size, _, x in chunks(batch):
                if size == d:
                    wide = exact(x, 2 * max(abs(int(x.max())), abs(int(x.min())), *map(abs, middle)))
                    scatter = scatter + gram(wide - np.array(middle, dtype=wide.dtype))
        rows = [(i, j, scatter[i, j]) for i in range(d) for j in range(i, d) if scatter[i, j]]
        if rows:
            yield sums_table(rows, ["i", "j"])

    schema = "i long, j long, high decimal(38,0), low decimal(38,0)"
    out = [[Fraction(0)] * d for _ in range(d)]
    off = [s - n * m for s, m in zip(sums, middle)]
    found = {(r["i"], r["j"]): total(r) for r in added(vectors.mapInArrow(fold, schema), "i", "j").collect()}
    for i in range(d):
        for j in range(i, d):
            out[i][j] = out[j][i] = Fraction(n * found.get((i, j), 0) - off[i] * off[j], n * n)
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``f`` of full column rank with ``f @ f.T == v``; triangular when its rows are put in the order of the pivots."""
    d = len(v)
    rest, f, done = v.copy(), np.zeros((d, d)), np.zeros(d, dtype=bool)
    noise = d * np.finfo(float).eps * v.diagonal()  # what rounding leaves of a dependent dimension, in its own scale
    for k in range(d):
        left = np.where(done | (rest.diagonal() <= noise), -np.inf, rest.diagonal())
        p = int(left.argmax())
        if left[p] < 0:
            return f[:, :k]
        f[:, k] = np.where(done, 0, rest[:, p]) / np.sqrt(rest[p, p])
        f[p, k] = np.sqrt(rest[p, p])
        done[p] = True
        rest -= np.outer(f[:, k], f[:, k])
    return f


def rounds_of(columns: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns, in rounds of disjoint ones (the circle method)."""
    m = columns + columns % 2
    ring = list(range(m))
    out = []
    for _ in range(m - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: m // 2], ring[: m // 2 - 1 : -1])]
        pairs = [(a, b) for a, b in pairs if b < columns]
        out.append((np.array([a for a, _ in pairs], dtype=int), np.array([b for _, b in pairs], dtype=int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(f: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``f`` times an orthogonal matrix, so that all columns are orthogonal to working precision."""
    a = f.copy()
    tolerance = np.finfo(float).eps * np.sqrt(max(len(f), 1))
    rounds = rounds_of(a.shape[1]) if a.shape[1] > 1 else []
    for _ in range(sweeps):
        still = True
        for i, j in rounds:
            p, q = a[:, i], a[:, j]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            turn = np.abs(pq) > tolerance * np.sqrt(pp * qq)
            if not turn.any():
                continue
            still = False
            zeta = (qq - pp) / (2 * np.where(turn, pq, 1))
            t = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, i], a[:, j] = c * p - c * t * q, c * t * p + c * q
        if still:
            break
    return a


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of ``v``, falling, and their unit eigenvectors as columns (largest entry positive)."""
    top = float(v.diagonal().max()) if len(v) else 0.0
    if top <= 0:
        return np.zeros(0), np.zeros((len(v), 0))
    a = one_sided_jacobi(pivoted_cholesky(v / top))
    e = (a * a).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    u = a[:, order] / np.sqrt(e[order])
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return e[order] * top, u


def fit(df: DataFrame, vector_col: str = "embedding") -> Whitening:
    """Learn the whitening from all vectors of ``df``."""
    vectors = df.select(col(vector_col).cast("array<double>").alias("v"))
    n, sums = first_moments(vectors)
    if not n or not sums:
        return Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    v = covariance(vectors, n, sums)
    e, u = components_of(np.array([[float(x) for x in row] for row in v]))
    return Whitening(n, sums, e, u, float(sum(v[i][i] for i in range(len(v)))))


def projector(model: Whitening, components: int):
    """Function of grid vectors: whitened values of the first components, and the exact squared deviations times n * n."""
    scaled = model.components[:, :components] / np.sqrt(model.eigenvalues[:components])
    largest = max([abs(s) for s in model.sums], default=0)

    def apply(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        wide = exact(x, 2 * max(model.n * max(abs(int(x.max())), abs(int(x.min()))), largest))
        off = wide * model.n - np.array(model.sums, dtype=wide.dtype)  # n * x - S, exact
        most = max(abs(int(off.max())), abs(int(off.min()))) ** 2 * off.shape[1]
        return (off / model.n).astype(np.float64) @ scaled, (exact(off, most) ** 2).sum(axis=1).tolist()

    return apply


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector: its id, ``deviation`` and ``whitened``, the values of the first ``components``."""
    d, k = model.dim, min(components, len(model.eigenvalues))
    rows = df.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v"))
    apply = projector(model, k)

    def run(batches):
        for batch in batches:
            for size, at, x in chunks(batch, 1):
                if size != d:
                    continue
                y, deviations = apply(x) if d else (np.zeros((len(at), 0)), [0] * len(at))
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)),
                    pa.array([v if v < 1 << 63 else None for v in deviations], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(y.ravel(), pa.float64()))], names=["id", "deviation", "whitened"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", id_col)


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding", components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on ``df``."""
    d, k = model.dim, min(components, len(model.eigenvalues))
    if not k:
        return 0.0
    vectors = df.select(col(vector_col).cast("array<double>").alias("v"))
    apply = projector(model, k)

    def fold(batches):
        products, means = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for size, _, x in chunks(batch):
                if size == d:
                    y = apply(x)[0]
                    products += y.T @ y
                    means += y.sum(axis=0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, np.full(k, -1))), pa.array(np.append(j, np.arange(k))), pa.array(np.append(products[i, j], means))],
            names=["i", "j", "s"])

    rows = vectors.mapInArrow(fold, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    mean = {r["j"]: r["s"] / model.n for r in rows if r["i"] < 0}
    return max(abs(r["s"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows if r["i"] >= 0)
