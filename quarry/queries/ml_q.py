"""Registered ML-preparation, evaluation, sweep and prompt queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mlprep as M
from ..operators import prompt as PR
from ..operators import sweep as SW
from .registry import register
from .tables import table

_SPLIT_TIME = ("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= "
               "CAST(floor(count(*) OVER () * (1 - 0.2)) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM orders")


@register("split_time", _SPLIT_TIME)
def split_time(spark, sf):
    return M.split_time(table(spark, sf, "orders"), "o_orderdate", 0.2, tiebreak=["o_orderkey"]).select("o_orderkey", "split")


@register("split_random",
          "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey) "
          "<= CAST(ceil(count(*) OVER () * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM orders")
def split_random(spark, sf):
    return M.split_random(table(spark, sf, "orders"), "o_orderkey", 0.2, 42).select("o_orderkey", "split")


@register("split_shapes",
          f"WITH s AS ({_SPLIT_TIME}) SELECT * FROM (VALUES ('X_train', 2), ('y_train', 1), ('X_val', 2), ('y_val', 1)) v(part, cols_n) "
          "JOIN (SELECT split, count(*) AS n FROM s GROUP BY 1) c ON c.split = CASE WHEN v.part LIKE '%train' THEN 'train' ELSE 'val' END "
          "ORDER BY 1")
def split_shapes(spark, sf):
    df = M.split_time(table(spark, sf, "orders"), "o_orderdate", 0.2, tiebreak=["o_orderkey"])
    out = M.split_shapes(df, ["o_custkey", "o_totalprice", "o_orderpriority"], "o_orderstatus")
    return out.select("part", F.col("cols").cast("int").alias("cols_n"),
                      F.when(F.col("part").endswith("train"), "train").otherwise("val").alias("split"), F.col("rows").alias("n"))


@register("encode_target",
          f"WITH s AS ({_SPLIT_TIME}), o AS (SELECT o.o_orderkey, o.o_orderstatus, s.split FROM orders o JOIN s USING (o_orderkey)), "
          "d AS (SELECT o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS BIGINT) AS code FROM "
          "(SELECT DISTINCT o_orderstatus FROM o WHERE split = 'train')) "
          "SELECT o.o_orderkey, o.split, coalesce(d.code, -1) AS o_orderstatus FROM o LEFT JOIN d USING (o_orderstatus)")
def encode_target(spark, sf):
    df = M.split_time(table(spark, sf, "orders"), "o_orderdate", 0.2, tiebreak=["o_orderkey"])
    tr, va, _k = M.encode_target(df.where(F.col("split") == "train"), df.where(F.col("split") == "val"), "o_orderstatus")
    return tr.unionByName(va).select("o_orderkey", "split", "o_orderstatus")


_CLS = ("WITH c AS (SELECT quality AS y, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), "
        "l AS (SELECT y, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM c GROUP BY 1), "
        "pr AS (SELECT p AS y, sum(n) AS predicted FROM c GROUP BY 1), j AS (SELECT l.*, coalesce(pr.predicted, 0) AS predicted FROM l LEFT JOIN pr USING (y)) "
        "SELECT round(sum(tp) / sum(support), 6) AS accuracy, "
        "round(sum(CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END * support) / sum(support), 6) AS precision, "
        "round(sum(CAST(tp AS DOUBLE) / support * support) / sum(support), 6) AS recall FROM j")


@register("eval_classification", _CLS)
def eval_classification(spark, sf):
    return M.eval_classification(table(spark, sf, "labels"), "quality", "toxic")


@register("eval_regression",
          "WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem), m AS (SELECT avg(y) AS my FROM t) "
          "SELECT round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2, round(sqrt(sum((y - p) * (y - p)) / count(*)), 6) AS rmse, "
          "round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape, "
          "round(1 - avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS one_minus_mape FROM t, m")
def eval_regression(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("pred", F.col("l_quantity") * 1500.0)
    return M.eval_regression(df, "l_extendedprice", "pred")


def _sweep(spark, sf):
    """All candidates of each depth: depth 2 has four, so no patience ends it earlier."""
    emb = table(spark, sf, "embeddings")
    sp = M.split_random(emb, "vec_id", 0.2, 42)
    tr, va = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val")
    return SW.model_sweep(tr, va, "embedding", "label", depths=(1, 2), units=(16, 32), patience=4, min_candidates=4, max_iter=30)


@register("model_sweep")
def model_sweep(spark, sf):
    """Rows-only: trained-network scores are not SQL-expressible."""
    return _sweep(spark, sf)


@register("model_sweep_regression")
def model_sweep_regression(spark, sf):
    """Rows-only: boosted trees' scores are not SQL-expressible."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").dropna()
    sp = M.split_random(part, "p_partkey", 0.2, 42)
    tr, va = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val")
    return SW.model_sweep(tr, va, ["p_partkey", "p_size"], "p_retailprice", depths=(1, 2), units=(5, 10), patience=2, min_candidates=2, task="regression")


_HALVING_SQL = (
    "WITH d AS (SELECT len(any_value(embedding)) AS n_in, max(label) + 1 AS n_out FROM embeddings), u(u) AS (VALUES (16), (32)), "
    "c AS (SELECT 1 AS depth, u AS a, 0 AS b, n_in || '-' || u || '-' || n_out AS layers FROM u, d "
    "UNION ALL SELECT 2, x.u, y.u, n_in || '-' || x.u || '-' || y.u || '-' || n_out FROM u x, u y, d), "
    "l AS (SELECT string_agg(layers, ' ' ORDER BY depth, a + b, greatest(a, b) - least(a, b), a, b) AS layers, count(*) AS n FROM c), "
    "r AS (SELECT r, CAST(ceil(n / power(2, r)) AS BIGINT) AS n, layers FROM l, range(0, 4) t(r)) "
    "SELECT CAST(r AS INTEGER) AS round, n AS candidates, CAST(CASE WHEN n > 1 THEN ceil(n / 2.0) ELSE 0 END AS BIGINT) AS kept, "
    "CAST(8 * (power(2, r + 1) - 1) AS INTEGER) AS iterations, CASE WHEN r = 0 THEN layers END AS layers, "
    "true AS from_kept, true AS by_reward FROM r")


@register("model_sweep_halving", _HALVING_SQL)
def model_sweep_halving(spark, sf):
    """A row a round: who was tried (round 0), how many went on and after how many iterations; whether the round's
    candidates are those the round before kept (``from_kept``), and whether no dropped one had the better reward (``by_reward``)."""
    sp = M.split_random(table(spark, sf, "embeddings"), "vec_id", 0.2, 42)
    tr, va = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val")
    found = SW.halving_sweep(tr, va, "embedding", "label", depths=(1, 2), units=(16, 32), first_iter=8)
    inputs = F.sort_array(F.collect_set("candidate"))  # six candidates
    went_on = F.sort_array(F.collect_set(F.when(F.col("kept"), F.col("candidate"))))
    worst_kept, best_dropped = F.min(F.when(F.col("kept"), F.col("reward"))), F.max(F.when(~F.col("kept"), F.col("reward")))
    rounds = found.groupBy("round").agg(
        F.count("*").alias("candidates"), F.count_if("kept").alias("kept"), F.max("iterations").alias("iterations"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("candidate", "layers"))), lambda s: s["layers"]), " ").alias("layers"),
        F.coalesce(worst_kept >= best_dropped, F.lit(True)).alias("by_reward"), inputs.alias("inputs"), went_on.alias("went_on"))
    before = rounds.select((F.col("round") + 1).alias("round"), F.col("went_on").alias("allowed"))
    return rounds.join(before, "round", "left").select(
        "round", "candidates", "kept", "iterations", F.when(F.col("round") == 0, F.col("layers")).alias("layers"),
        F.coalesce(F.col("inputs") == F.col("allowed"), F.col("round") == 0).alias("from_kept"), "by_reward")


def _halving_decisions_sql(rounds: int, target: float) -> str:
    """Round r + 1 has what round r kept: the better half, rounded up, unless a reward reached the target."""
    ctes = ["e AS (SELECT user_id AS candidate, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS round, "
            "value AS reward FROM events)", "l0 AS (SELECT DISTINCT candidate FROM e)"]
    for r in range(rounds):
        ctes.append(f"h{r} AS (SELECT {r} AS round, l.candidate, e.reward FROM l{r} l LEFT JOIN e ON e.candidate = l.candidate AND e.round = {r})")
        ctes.append(f"k{r} AS (SELECT *, count(*) OVER () > 1 AND row_number() OVER (ORDER BY reward DESC NULLS LAST, candidate) <= ceil(count(*) OVER () / 2.0) "
                    f"AND NOT coalesce(max(reward) OVER () >= {target}, false) AS kept FROM h{r})")
        ctes.append(f"l{r + 1} AS (SELECT candidate FROM k{r} WHERE kept)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT round, candidate, reward, kept FROM k{r}" for r in range(rounds))


def _halving_of_events(spark, sf, target):
    first = Window.partitionBy("user_id").orderBy("event_id")
    rewards = table(spark, sf, "events").select(
        F.col("user_id").alias("candidate"), (F.row_number().over(first) - 1).alias("round"), F.col("value").alias("reward"))
    return SW.halving_rounds(rewards, 5, target)


@register("halving_rounds", _halving_decisions_sql(5, 1e9))
def halving_rounds(spark, sf):
    """Users as candidates, their events' values as the rewards of the rounds; no reward reaches the target."""
    return _halving_of_events(spark, sf, 1e9)


@register("halving_rounds_stopped", _halving_decisions_sql(5, 100.0))
def halving_rounds_stopped(spark, sf):
    return _halving_of_events(spark, sf, 100.0)


HISTORY_SQL = "SELECT event_id AS candidate, user_id % 5 AS depth, value AS reward FROM events"


def event_history(spark, sf):
    """A search history of one candidate per event."""
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("candidate"), (F.col("user_id") % 5).alias("depth"), F.col("value").alias("reward"))


@register("history_best",
          f"WITH h AS ({HISTORY_SQL}), d AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY reward DESC, candidate) AS r, "
          "row_number() OVER (ORDER BY reward DESC, candidate) AS o FROM h) "
          "SELECT candidate, depth, reward, CAST(r AS INTEGER) AS rank, 'depth' AS scope FROM d WHERE r <= 3 "
          "UNION ALL SELECT candidate, depth, reward, CAST(o AS INTEGER), 'overall' FROM d WHERE o <= 3")
def history_best(spark, sf):
    return M.history_best(event_history(spark, sf), top=3)


@register("render_prompt",
          "SELECT conv_id, turn, '[' || role || '] turn ' || CAST(turn AS VARCHAR) || ': ' || text AS prompt FROM conversations")
def render_prompt(spark, sf):
    df = PR.render_prompt(table(spark, sf, "conversations"), "[{role}] turn {turn}: {text}")
    return df.select("conv_id", "turn", "prompt")
