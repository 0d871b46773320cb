"""Successive halving: who goes on, when it stops, and that it ends where training everything in full does."""

import math
import random

from pyspark.sql import functions as F

from quarry.operators import mlprep as M
from quarry.operators import sweep as SW
from quarry.queries.tables import table

from .conftest import SF_SMALL


def by_hand(rows, rounds, target=None):
    of = {(r, c): v for r, c, v in rows}
    live, out = sorted({c for _, c, _ in rows}), []
    for r in range(rounds):
        known = {c: v for c in live if (v := of.get((r, c))) is not None and not math.isnan(v)}
        order = sorted(live, key=lambda c: (c not in known, -known.get(c, 0.0), c))
        stop = len(live) < 2 or target is not None and any(v >= target for v in known.values())
        kept = set() if stop else set(order[: (len(live) + 1) // 2])
        out += [(r, c, c in kept) for c in live]
        live = sorted(kept)
        if not live:
            break
    return sorted(out)


def test_rounds(spark):
    r = random.Random(3)
    for n, target, kw in ((1, None, {}), (2, None, {}), (13, None, {}), (40, 7.5, {}), (60, None, {"rows_per_bucket": 5})):
        rows = [(k, c, r.choice([None, float("nan"), 1.0, 2.0, float(r.randrange(9))])) for k in range(4) for c in range(n) if (k + c) % 7]
        df = spark.createDataFrame(rows, "round int, candidate int, reward double")
        got = SW.halving_rounds(df, 4, target, **kw).collect()
        assert sorted((g["round"], g["candidate"], g["kept"]) for g in got) == by_hand(rows, 4, target)


def test_no_candidates(spark):
    assert SW.halving_rounds(spark.createDataFrame([], "round int, candidate int, reward double"), 3).count() == 0


def test_same_winner_as_the_full_run(spark):
    sp = M.split_random(table(spark, SF_SMALL, "embeddings"), "vec_id", 0.2, 42)
    tr, va = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val")
    some = dict(depths=(1,), units=(2, 16))
    found = SW.halving_sweep(tr, va, "embedding", "label", first_iter=8, **some).orderBy("round", "candidate").collect()
    assert [(f["round"], f["iterations"]) for f in found] == [(0, 8), (0, 8), (1, 24)] and not found[-1]["kept"]
    full = SW.model_sweep(tr, va, "embedding", "label", patience=9, max_iter=24, **some).collect()
    assert found[-1]["layers"] == max(full, key=lambda f: (f["reward"], -f["candidate"]))["layers"]
    stopped = SW.halving_sweep(tr, va, "embedding", "label", first_iter=2, target=0.0, **some).collect()
    assert len(stopped) == 2 and not any(s["kept"] for s in stopped)
