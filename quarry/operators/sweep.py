"""Model sweep (SURVEY 2.13, re-aimed from the reference's neural-architecture search).

Per depth (number of hidden layers, from 1 up) candidate dense networks are
trained with MLlib's distributed ``MultilayerPerceptronClassifier`` and scored on
the validation side; a depth is left after ``patience`` candidates without
improvement (after ``min_candidates``), and the whole sweep stops once the
reward reaches ``target``.  The driver only sequences fits; every fit and every
score is a distributed job.  The result is the history table.

``halving_sweep`` trains all candidates of all depths side by side for a few iterations, and only the
better half goes on, with twice the iterations, from the weights it has; ``halving_rounds`` says who goes on.
"""

from __future__ import annotations

import itertools
import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import free_names, q
from ..plans.guards import cut_lineage
from ..plans.ordered import first_rows
from .mlprep import eval_classification, eval_regression

HISTORY_SCHEMA = "candidate int, depth int, layers string, reward double, accuracy double, precision double, recall double"


def _features(df: DataFrame, features) -> DataFrame:
    if isinstance(features, str):
        dt = df.schema[features].dataType.simpleString()
        if dt.startswith("array"):
            return df.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))
        return df.withColumn("_features", F.col(features))
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error").transform(df)


def networks(n_in: int, n_classes: int, depth: int, units) -> list[tuple[int, ...]]:
    """All networks of a depth, smaller and more even ones first."""
    every = sorted(itertools.product(units, repeat=depth), key=lambda h: (sum(h), max(h) - min(h), h))
    return [(n_in, *hidden, n_classes) for hidden in every]


def model_sweep(train: DataFrame, val: DataFrame, features, label: str, depths=(1, 2, 3), units=(16, 32, 64),
                patience: int = 2, min_candidates: int = 2, target: float = 1.01, max_iter: int = 50, seed: int = 42,
                task: str = "classification") -> DataFrame:
    """The history of all tried candidates.

    ``task="regression"``: boosted trees of the given depth, ``units`` are their numbers, and the reward is
    1 - MAPE.  Rows with a NULL feature or label raise; impute or drop them first."""
    spark = train.sparkSession
    tr = _features(train, features).select("_features", q(label).cast("double").alias("_label")).cache()
    va = _features(val, features).select("_features", q(label).cast("double").alias("_label")).cache()
    regression = task == "regression"
    n_in = len(tr.first()["_features"])
    n_classes = 0 if regression else int(tr.agg(F.max("_label")).first()[0]) + 1

    rows, cand, best_all = [], 0, -1.0
    for depth in depths:
        best, stale, tried = -1.0, 0, 0
        for layers in [(u,) for u in units] if regression else networks(n_in, n_classes, depth, units):
            cand += 1
            tried += 1
            if regression:
                model = GBTRegressor(featuresCol="_features", labelCol="_label", maxDepth=depth, maxIter=layers[0], seed=seed).fit(tr)
                reward = float(eval_regression(model.transform(va), "_label", "prediction").first()["one_minus_mape"])
                scores = (None, None, None)
            else:
                model = MultilayerPerceptronClassifier(featuresCol="_features", labelCol="_label", layers=list(layers),
                                                       maxIter=max_iter, seed=seed).fit(tr)
                m = eval_classification(model.transform(va).select("_label", "prediction"), "_label", "prediction").first()
                scores = tuple(float(m[k]) for k in ("accuracy", "precision", "recall"))
                reward = scores[0]
            rows.append((cand, depth, "-".join(map(str, layers)), reward, *scores))
            if reward > best:
                best, stale = reward, 0
            else:
                stale += 1
            best_all = max(best_all, reward)
            if best_all >= target or (tried >= min_candidates and stale >= patience):
                break
        if best_all >= target:
            break
    tr.unpersist()
    va.unpersist()
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def better_half(rewards: DataFrame, target: float | None = None, **kw) -> DataFrame:
    """``rewards`` (candidate, reward, ...) of one round with ``kept``: the better half, rounded up; of equal rewards the smaller candidate.

    A NULL or NaN reward is the worst.  One candidate alone isn't kept: it is the winner.  Where a reward reaches
    ``target`` nobody is: the search stops.  Candidates are compared with the one in the middle (``plans.ordered``), so
    their number isn't bounded; ``kw`` goes there."""
    reward = F.when(~F.isnan("reward"), F.col("reward"))
    n, best = rewards.agg(F.count("*"), F.max(reward)).first()
    if n < 2 or (target is not None and best is not None and best >= target):
        return rewards.withColumn("kept", F.lit(False))
    unknown, loss, first = free_names(rewards.columns, "unknown", "loss", "first")
    ranked = rewards.withColumns({unknown: reward.isNull(), loss: F.coalesce(-reward, F.lit(0.0))})
    halves = first_rows(ranked, [unknown, loss, "candidate"], math.ceil(n / 2), first, n, **kw)
    return halves.select(*[q(c) for c in rewards.columns], q(first).alias("kept"))


def halving_rounds(rewards: DataFrame, rounds: int, target: float | None = None, **kw) -> DataFrame:
    """(round, candidate, reward, kept): who takes part in which round, given each candidate's ``reward`` in each ``round`` (from 0).

    Round 0 has all candidates, a later one those kept by ``better_half``.  A candidate without a reward in its
    round has NULL there.  One candidate has at most one row a round."""
    live, out = rewards.select("candidate").distinct(), None
    for r in range(rounds):
        here = live.join(rewards.where(F.col("round") == r).select("candidate", "reward"), "candidate", "left")
        decided = better_half(cut_lineage(here), target, **kw)
        decided = cut_lineage(decided.select(F.lit(r).alias("round"), "candidate", "reward", "kept"))
        out = decided if out is None else out.unionByName(decided)
        live = decided.where("kept").select("candidate")
        if live.isEmpty():
            break
    return out


HALVING_SCHEMA = "round int, candidate int, depth int, layers string, iterations int, reward double, precision double, recall double"


def halving_sweep(train: DataFrame, val: DataFrame, features, label: str, depths=(1, 2, 3), units=(16, 32, 64), first_iter: int = 10,
                  target: float = 1.01, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """Successive halving over the dense networks of all ``depths``: round, candidate, layers, iterations so far, reward, ``kept``.

    All candidates train ``first_iter`` iterations, ``parallelism`` of them at a time (their jobs share the
    cluster); the better half goes on from its weights with twice as many more, and so on until one is left, which
    gets its round too, or a reward (accuracy on ``val``) reaches ``target``.  The budget: with n candidates a
    round spends fewer than (n + 2^round) * first_iter iterations, and there are at most 1 + ceil(log2 n) rounds.  Rows with a
    NULL feature or label raise."""
    spark = train.sparkSession
    tr = _features(train, features).select("_features", q(label).cast("double").alias("_label")).cache()
    va = _features(val, features).select("_features", q(label).cast("double").alias("_label")).cache()
    n_in, n_classes = len(tr.first()["_features"]), int(tr.agg(F.max("_label")).first()[0]) + 1
    every = [(d, layers) for d in depths for layers in networks(n_in, n_classes, d, units)]
    live = {i: (d, layers, None) for i, (d, layers) in enumerate(every, 1)}
    done, spent, out = 0, first_iter, None
    try:
        while live:
            def fit(i: int, more: int = spent):
                _, layers, weights = live[i]
                mlp = MultilayerPerceptronClassifier(featuresCol="_features", labelCol="_label", layers=list(layers), maxIter=more, seed=seed)
                model = (mlp if weights is None else mlp.setInitialWeights(weights)).fit(tr)
                m = eval_classification(model.transform(va).select("_label", "prediction"), "_label", "prediction").first()
                return i, model.weights, m

            total = first_iter * (2 ** (done + 1) - 1)
            with ThreadPool(min(parallelism, len(live))) as pool:
                results = pool.map(inheritable_thread_target(spark)(fit), list(live))
            rows = [(done, i, live[i][0], "-".join(map(str, live[i][1])), total, float(m["accuracy"]), float(m["precision"]), float(m["recall"]))
                    for i, _, m in results]
            decided = cut_lineage(better_half(spark.createDataFrame(rows, HALVING_SCHEMA), target))
            out = decided if out is None else out.unionByName(decided)
            kept = {r["candidate"] for r in decided.where("kept").select("candidate").collect()}  # candidates
            live = {i: (*live[i][:2], weights) for i, weights, _ in results if i in kept}
            done, spent = done + 1, spent * 2
    finally:
        tr.unpersist()
        va.unpersist()
    return out
