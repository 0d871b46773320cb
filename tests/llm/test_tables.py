"""Whitening, source divergences and shards, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, sharding, whitening

from . import data

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate([*data.CLASHES, "v", "whitened", "deviation", "i", "j"])])


def exact_fit(rows):
    xs = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v, *_ in rows]
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    d = len(sums)
    v = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs), n**3) for j in range(d)] for i in range(d)]
    return xs, n, sums, v


@pytest.mark.parametrize("seed", range(3))
def test_whitening_is_the_eigen_solution(spark, seed):
    rng = np.random.default_rng(seed)
    d = [3, 8, 40][seed]
    raw = (rng.normal(size=(90, d)) @ rng.normal(size=(d, d)) * 10 + rng.normal(size=d) * 1000).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(raw)]
    df = vectors(spark, rows)
    m = whitening.fit(df)
    xs, n, sums, v = exact_fit(rows)
    assert (m.n, m.sums) == (n, sums)
    e = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in v]))[::-1]
    assert np.allclose(m.eigenvalues, e, rtol=1e-9)
    assert np.allclose(m.components.T @ m.components, np.eye(d), atol=1e-12)
    residual = np.array([[float(c) for c in r] for r in v]) @ m.components - m.components * m.eigenvalues
    assert np.abs(residual).max() <= 1e-12 * e[0]
    assert whitening.identity_error(df, m) < 1e-9
    out = {r.vec_id: r for r in whitening.whiten(df, m, components=5).collect()}
    for i, x in enumerate(xs):
        off = [n * a - s for a, s in zip(x, sums)]
        assert out[i].deviation == sum(o * o for o in off)
        assert np.allclose(out[i].whitened, (np.array([o / n for o in off]) @ m.components / np.sqrt(m.eigenvalues))[:5])


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix: the smallest eigenvalue is right relative to itself, not to the largest."""
    scale = np.diag([1e8, 1e4, 1.0, 1e-4])
    rng = np.random.default_rng(1)
    b = rng.normal(size=(4, 4))
    core = b @ b.T + 4 * np.eye(4)
    e, u = whitening.components_of(scale @ core @ scale)
    exact = 1.0
    for k in range(4):  # the product of all eigenvalues is the determinant
        exact *= e[k]
    assert exact == pytest.approx(np.linalg.det(core) * np.prod(np.diag(scale)) ** 2, rel=1e-9)
    assert whitening.pivoted_cholesky(np.ones((3, 3))).shape == (3, 1)
    assert [len(whitening.rounds_of(k)) for k in (2, 5, 6)] == [1, 5, 5]
    for k in (2, 5, 6):
        met = [(a, b) for i, j in whitening.rounds_of(k) for a, b in zip(i.tolist(), j.tolist())]
        assert sorted(met) == [(a, b) for a in range(k) for b in range(a + 1, k)]


def test_sums_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    for size in (3, 1 << 25, 1 << 33, 1 << 61):
        d = rng.integers(-size, size, (50, 4))
        want = [[sum(int(r[i]) * int(r[j]) for r in d) for j in range(4)] for i in range(4)]
        assert whitening.gram(d).tolist() == want
        assert whitening.column_sums(d).tolist() == [sum(int(r[i]) for r in d) for i in range(4)]
    for v in (0, -1, 1 << 200 >> 90, -(1 << 100)):
        high, low = whitening.halves(v)
        assert int(high) * whitening.HALF + int(low) == v


def test_whitening_edge_cases(spark):
    good = [(i, [float(i % 5), float(i * i % 7), 1.0], 0) for i in range(20)]
    odd = [(100, None, 0), (101, [1.0, None, 1.0], 0), (102, [1.0, NAN, 1.0], 0), (103, [INF, 1.0, 1.0], 0), (104, [1.0], 0), (105, [], 0), (None, [1.0, 2.0, 1.0], 0), (3, good[3][1], 0)]
    df = vectors(spark, good + odd)
    m = whitening.fit(df)
    _, n, sums, _ = exact_fit(good + odd[-2:])
    assert (m.n, m.sums) == (n, sums) and len(m.eigenvalues) == 2  # the third dimension is constant
    out = whitening.whiten(df, m).collect()
    assert Counter(r.vec_id for r in out) == Counter([*range(20), None, 3]) and {len(r.whitened) for r in out} == {2}
    assert whitening.identity_error(df, m) < 1e-9
    for rows in ([], odd[:4], good[:1], [good[0]] * 3, [(1, [], 0)]):
        df = vectors(spark, rows)
        m = whitening.fit(df)
        assert len(m.eigenvalues) == 0 and whitening.identity_error(df, m) == 0
        assert [r.whitened for r in whitening.whiten(df, m).collect()] == [[]] * m.n
    huge = vectors(spark, [(1, [3e38, 0.0], 0), (2, [-3e38, 5.0], 0), (3, [0.0, 1.0], 0)])
    m = whitening.fit(huge)
    assert len(m.eigenvalues) >= 1 and whitening.whiten(huge, m).where("deviation is null").count() == 2  # the third is the mean


def brute_divergences(rows, min_docs, top):
    """``rows`` are (lang, source, text)."""
    found = set()
    df, cnt, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        cnt[lang, source].update(words)
        df[lang].update(set(words))
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: share(cnt[lang, s]) for s in sources}
        q = share(sum((cnt[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            term = [(p[s][t] - q[t], t) for t in kept if cnt[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                found |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:most])}
    return found


@pytest.mark.parametrize("entries,bucket,run", [(400_000, 1 << 16, 1 << 20), (7, 2, 5)])
def test_divergences(spark, monkeypatch, entries, bucket, run):
    for name, value in (("STRIPE_CELLS", entries), ("BUCKET", bucket), ("RUN", run), ("PAIR_BLOCK", bucket)):
        monkeypatch.setattr(divergence, name, value)
    random.seed(entries)
    vocabulary = ["the", "The", "Über", "über", "ÉTÉ", "z", "a b", "x1y", "日本", "𝒳", "\x7f", "don't"]
    rows = [(random.choice(["en", "en", None, "de"]), random.choice(["s1", "s2", "é", None, "S1"]), " ".join(random.choices(vocabulary, k=random.randint(0, 12)))) for _ in range(120)]
    rows += [("xx", "only", None), ("yy", "a", ""), ("yy", "b", "once"), ("en", "silent", None), ("en", "s1", data.LONG)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").select("*", *[F.lit(1).alias(c) for c in ("term", "df", "sources", "counts", "n", "v", "salt")])
    out = divergence.divergences(df, min_docs=4, top=3).collect()
    assert len(out) == len(set(out))
    assert {tuple(r) for r in out} == brute_divergences(rows, 4, 3)
    assert divergence.divergences(df.limit(0)).count() == 0


def test_shares_of_large_counts():
    count, size = np.array([0, 9 * 10**11, 3]), np.array([10**12] * 3)
    assert divergence.shares(count, size).tolist() == [1 + 10**9 * (c + 5) // 10**12 for c in count.tolist()]


def brute_shards(rows, shards):
    import hashlib

    key = lambda r: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0)
    total, before, out, slots = sum(len((r[1] or "").encode()) + 8 for r in rows), 0, Counter(), Counter()
    for r in sorted(rows, key=key):
        raw = (r[1] or "").encode()
        at = before * shards // total
        out[r[0], len(raw) + 8, zlib.crc32(raw), at, slots[at]] += 1
        slots[at] += 1
        before += len(raw) + 8
    return out


@pytest.mark.parametrize("max_rows,shards", [(1 << 20, 24), (40, 3), (5, 300)])
def test_shards(spark, max_rows, shards):
    random.seed(shards)
    rows = [(r[0], r[1]) for r in data.ROWS] + [(random.choice([None, i]), "copy of one text") for i in range(300)] + [(7, "same row")] * 100
    rows += [(1000 + i, "x" * random.randint(0, 200)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", *[F.lit(1).alias(c) for c in (*data.CLASHES, "key", "no", "range", "bytes", "rank")])
    out = sharding.shard(df, shards, max_rows=max_rows).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out) == brute_shards(rows, shards)
    assert sharding.shard(df.limit(0), shards).collect() == []
    few = sharding.shard(df.limit(1), shards).collect()
    assert [(r.shard, r.slot) for r in few] == [(0, 0)]


def test_binary_search(spark):
    for n in (0, 1, 2, 255):
        cuts = sorted(random.sample(range(1000), n))
        row = spark.range(1000).select("id", sharding.place_among(F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.col("id")).alias("at")).collect()
        assert [r["at"] for r in row] == [sum(c <= i for c in cuts) for i in range(1000)]
