"""Registered transform-step queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import distribution as D
from ..operators import encode as E
from ..operators import impute as I
from ..operators import outliers as O
from ..operators import rows as R
from ..operators import scale as S
from ..plans.runner import Step, run_pipeline
from ..plans.fitted import transform
from .registry import register
from .sqlgen import r6
from .tables import table, with_fixture


def _out(df, key, cols):
    return df.select(key, *[rnd(F.col(c)).alias(c) for c in cols])


OG = "orders_gappy"
LG = "lineitem_gappy"

# ---------------------------------------------------------------- imputation


@register("fillna_mean", with_fixture(
    f"SELECT o_orderkey, {r6('coalesce(price_n, (SELECT avg(price_n) FROM orders_gappy))')} AS price_n FROM orders_gappy", OG))
def fillna_mean(spark, sf):
    return _out(I.fillna_mean(table(spark, sf, OG), ["price_n", "priority_n"]), "o_orderkey", ["price_n"])


@register("fillna_median", with_fixture(
    f"SELECT o_orderkey, {r6('coalesce(price_n, (SELECT quantile_cont(price_n, 0.5) FROM orders_gappy))')} AS price_n FROM orders_gappy", OG))
def fillna_median(spark, sf):
    return _out(I.fillna_median(table(spark, sf, OG), ["price_n"]), "o_orderkey", ["price_n"])


@register("fillna_mode", with_fixture(
    "SELECT o_orderkey, coalesce(priority_n, (SELECT priority_n FROM orders_gappy WHERE priority_n IS NOT NULL "
    "GROUP BY 1 ORDER BY count(*) DESC, priority_n LIMIT 1)) AS priority_n FROM orders_gappy", OG))
def fillna_mode(spark, sf):
    return I.fillna_mode(table(spark, sf, OG), ["priority_n"]).select("o_orderkey", "priority_n")


@register("fillna_ffill", with_fixture(
    f"SELECT o_orderkey, {r6('last_value(price_n IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS price_n, "
    "last_value(priority_n IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS priority_n "
    "FROM orders_gappy", OG))
def fillna_ffill(spark, sf):
    df = I.fillna_ffill(table(spark, sf, OG), ["price_n", "priority_n"], ["o_orderkey"])
    return df.select("o_orderkey", rnd(F.col("price_n")).alias("price_n"), "priority_n")


@register("fillna_bfill", with_fixture(
    f"SELECT o_orderkey, {r6('first_value(price_n IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS price_n "
    "FROM orders_gappy", OG))
def fillna_bfill(spark, sf):
    df = I.fillna_bfill(table(spark, sf, OG), ["price_n"], ["o_orderkey"], partition_by=["o_custkey"])
    return _out(df, "o_orderkey", ["price_n"])


# ---------------------------------------------------------------- rows


@register("dropna_rows", with_fixture(
    "SELECT o_orderkey, price_n, priority_n FROM orders_gappy WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL "
    "AND o_orderdate IS NOT NULL AND price_n IS NOT NULL AND priority_n IS NOT NULL", OG))
def dropna_rows(spark, sf):
    return R.dropna_rows(table(spark, sf, OG)).select("o_orderkey", "price_n", "priority_n")


@register("drop_duplicates_all", with_fixture(
    "SELECT DISTINCT user_id, event_type, CAST(d AS VARCHAR) AS d FROM events_dup", "events_dup"))
def drop_duplicates_all(spark, sf):
    return R.drop_duplicates_all(table(spark, sf, "events_dup")).select("user_id", "event_type", F.col("d").cast("string").alias("d"))


@register("drop_duplicates_subset",
          "SELECT d.doc_id, d.lang, d.n_chars FROM documents d JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) k "
          "ON d.doc_id = k.doc_id")
def drop_duplicates_subset(spark, sf):
    return R.drop_duplicates_subset(table(spark, sf, "documents"), ["text"], order_by=["doc_id"]).select("doc_id", "lang", "n_chars")


@register("derive", "SELECT o_orderkey, o_custkey * 2 + 1 AS k2, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders")
def derive(spark, sf):
    df = R.derive(table(spark, sf, "orders"), "k2", "o_custkey * 2 + 1")
    return R.derive(df, "order_year", "year(o_orderdate)").select("o_orderkey", "k2", "order_year")


@register("project_existing", "SELECT o_orderkey, o_totalprice FROM orders")
def project_existing(spark, sf):
    return R.project_existing(table(spark, sf, "orders"), ["o_orderkey", "not_a_column", "o_totalprice"])


@register("select_features", "SELECT o_totalprice, o_custkey, o_orderstatus, o_orderdate FROM orders")
def select_features(spark, sf):
    return R.select_features(table(spark, sf, "orders"), ["o_totalprice", "o_orderstatus", "o_custkey"], "o_orderstatus", "o_orderdate")


@register("select_numeric", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_numeric(spark, sf):
    return R.select_numeric(table(spark, sf, "orders"))


@register("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def drop_columns(spark, sf):
    return R.drop_columns(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate", "missing_col"])


# ---------------------------------------------------------------- scaling

SC = ["l_quantity", "price_n"]


def _scaled_sql(expr_of):
    cols = ", ".join(f"{r6(expr_of(c))} AS {c}" for c in SC)
    return with_fixture(f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem_gappy", LG)


@register("standard_scaler", _scaled_sql(lambda c: f"({c} - (SELECT avg({c}) FROM lineitem_gappy)) / (SELECT stddev_samp({c}) FROM lineitem_gappy)"))
def standard_scaler(spark, sf):
    return S.standard_scaler(table(spark, sf, LG), SC).select("l_orderkey", "l_linenumber", *[rnd(F.col(c)).alias(c) for c in SC])


@register("minmax_scaler", _scaled_sql(lambda c: f"({c} - (SELECT min({c}) FROM lineitem_gappy)) / ((SELECT max({c}) FROM lineitem_gappy) - (SELECT min({c}) FROM lineitem_gappy))"))
def minmax_scaler(spark, sf):
    return S.minmax_scaler(table(spark, sf, LG), SC).select("l_orderkey", "l_linenumber", *[rnd(F.col(c)).alias(c) for c in SC])


@register("robust_scaler", _scaled_sql(lambda c: f"({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem_gappy)) / ((SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem_gappy))"))
def robust_scaler(spark, sf):
    return S.robust_scaler(table(spark, sf, LG), SC).select("l_orderkey", "l_linenumber", *[rnd(F.col(c)).alias(c) for c in SC])


@register("maxabs_scaler", _scaled_sql(lambda c: f"{c} / (SELECT max(abs({c})) FROM lineitem_gappy)"))
def maxabs_scaler(spark, sf):
    return S.maxabs_scaler(table(spark, sf, LG), SC).select("l_orderkey", "l_linenumber", *[rnd(F.col(c)).alias(c) for c in SC])


UV = ["l_quantity", "l_discount", "l_tax"]
_NORM = "sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)"


@register("unit_vector_scaler", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{r6(f'CASE WHEN {_NORM} = 0 THEN {c} ELSE {c} / {_NORM} END')} AS {c}" for c in UV) + " FROM lineitem")
def unit_vector_scaler(spark, sf):
    return S.unit_vector_scaler(table(spark, sf, "lineitem"), UV).select("l_orderkey", "l_linenumber", *[rnd(F.col(c)).alias(c) for c in UV])


# ---------------------------------------------------------------- outliers


@register("clip_outliers", with_fixture("SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{r6(f'CASE WHEN {c} IS NULL THEN NULL ELSE greatest((SELECT quantile_cont({c}, 0.01) FROM lineitem_gappy), least((SELECT quantile_cont({c}, 0.99) FROM lineitem_gappy), {c})) END')} AS {c}"
    for c in ["l_extendedprice", "price_n"]) + " FROM lineitem_gappy", LG))
def clip_outliers(spark, sf):
    cols = ["l_extendedprice", "price_n"]
    return O.clip_outliers(table(spark, sf, LG), cols).select("l_orderkey", "l_linenumber", *[rnd(F.col(c)).alias(c) for c in cols])


_WIN = ("WITH s AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, "
        "count(*) OVER () AS n FROM lineitem), b AS (SELECT max(CASE WHEN i = CAST(floor(0.05 * n) AS BIGINT) THEN x END) AS lo, "
        "max(CASE WHEN i = n - 1 - CAST(floor(0.05 * n) AS BIGINT) THEN x END) AS hi FROM s) "
        f"SELECT l_orderkey, l_linenumber, {r6('greatest(b.lo, least(b.hi, l_extendedprice))')} AS l_extendedprice FROM lineitem, b")


@register("winsorize_outliers", _WIN)
def winsorize_outliers(spark, sf):
    df = O.winsorize_outliers(table(spark, sf, "lineitem"), ["l_extendedprice"], 0.05)
    return df.select("l_orderkey", "l_linenumber", rnd(F.col("l_extendedprice")).alias("l_extendedprice"))


_IQR = with_fixture(
    ", a AS (SELECT * FROM lineitem_gappy, (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 "
    "FROM lineitem_gappy) s WHERE l_quantity BETWEEN s.q1 - 1.5 * (s.q3 - s.q1) AND s.q3 + 1.5 * (s.q3 - s.q1)) "
    "SELECT l_orderkey, l_linenumber, l_quantity, price_n FROM a, (SELECT quantile_cont(price_n, 0.25) AS q1, "
    "quantile_cont(price_n, 0.75) AS q3 FROM a) s WHERE price_n BETWEEN s.q1 - 1.5 * (s.q3 - s.q1) AND s.q3 + 1.5 * (s.q3 - s.q1)",
    LG).replace(") , a AS", "), a AS")


@register("remove_outliers_iqr", _IQR)
def remove_outliers_iqr(spark, sf):
    df = transform("remove_outliers_iqr", table(spark, sf, LG), ["l_quantity", "price_n"], multiplier=1.5)
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "price_n")


_Z = ("WITH a AS (SELECT * FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) z "
      "WHERE abs((l_extendedprice - z.m) / z.s) < 2.0) SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax FROM a, "
      "(SELECT avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM a) z2 WHERE abs((l_tax - z2.m2) / z2.s2) < 2.0")


@register("remove_outliers_zscore", _Z)
def remove_outliers_zscore(spark, sf):
    df = transform("remove_outliers_zscore", table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], threshold=2.0)
    return df.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")


# ---------------------------------------------------------------- distribution


@register("log_transform",
          f"SELECT c_custkey, {r6('ln(c_acctbal - (SELECT min(c_acctbal) FROM customer) + 2)')} AS c_acctbal, "
          f"{r6('ln(1 + CAST(c_nationkey AS DOUBLE) - (SELECT min(c_nationkey) FROM customer) + 1)')} AS c_nationkey FROM customer")
def log_transform(spark, sf):
    df = D.log_transform(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return _out(df, "c_custkey", ["c_acctbal", "c_nationkey"])


@register("sqrt_transform",
          f"SELECT c_custkey, {r6('sqrt(c_acctbal - (SELECT min(c_acctbal) FROM customer))')} AS c_acctbal, "
          f"{r6('sqrt(CAST(c_nationkey AS DOUBLE))')} AS c_nationkey FROM customer")
def sqrt_transform(spark, sf):
    df = D.sqrt_transform(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return _out(df, "c_custkey", ["c_acctbal", "c_nationkey"])


@register("reciprocal_transform", f"SELECT l_orderkey, l_linenumber, {r6('1.0 / (l_discount + 1e-6)')} AS l_discount FROM lineitem")
def reciprocal_transform(spark, sf):
    return D.reciprocal_transform(table(spark, sf, "lineitem"), ["l_discount"]).select(
        "l_orderkey", "l_linenumber", rnd(F.col("l_discount")).alias("l_discount"))


@register("boxcox_transform")
def boxcox_transform(spark, sf):
    """Rows-only check: lambda is a likelihood fit (tested against a NumPy fit in tests/)."""
    df = D.boxcox_transform(table(spark, sf, "events"), ["value"])
    return _out(df, "event_id", ["value"])


@register("yeojohnson_transform")
def yeojohnson_transform(spark, sf):
    df = D.yeojohnson_transform(table(spark, sf, "customer"), ["c_acctbal"])
    return _out(df, "c_custkey", ["c_acctbal"])


def _qt_sql(src: str, key: str, c: str, normal: bool) -> str:
    body = (
        f"WITH s AS (SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) - 1 AS i FROM {src} WHERE {c} IS NOT NULL), "
        "c AS (SELECT count(*) AS n, least(1000, count(*)) AS m FROM s), "
        "g AS (SELECT j, CAST(j AS DOUBLE) / (m - 1) AS r, (n - 1) * (CAST(j AS DOUBLE) / (m - 1)) AS h, n FROM c, range(0, 1000) rr(j) WHERE j < m), "
        "k AS (SELECT g.r, s0.x + (s1.x - s0.x) * (g.h - floor(g.h)) AS u FROM g JOIN s s0 ON s0.i = CAST(floor(g.h) AS BIGINT) "
        "JOIN s s1 ON s1.i = least(CAST(floor(g.h) AS BIGINT) + 1, g.n - 1)), "
        "kd AS (SELECT u, min(r) AS rlo, max(r) AS rhi FROM k GROUP BY u), "
        "seg AS (SELECT u, rlo, rhi, lead(u) OVER (ORDER BY u) AS nu, lead(rlo) OVER (ORDER BY u) AS nrlo FROM kd), "
        "ext AS (SELECT min(u) AS umin, max(u) AS umax FROM kd), "
        f"y AS (SELECT t.{key} AS {key}, t.{c} AS x0, CASE WHEN CAST(t.{c} AS DOUBLE) - 1e-7 < ext.umin THEN 0.0 "
        f"WHEN CAST(t.{c} AS DOUBLE) + 1e-7 > ext.umax THEN 1.0 WHEN CAST(t.{c} AS DOUBLE) = seg.u THEN (seg.rlo + seg.rhi) / 2 "
        f"ELSE seg.rhi + (CAST(t.{c} AS DOUBLE) - seg.u) * (seg.nrlo - seg.rhi) / (seg.nu - seg.u) END AS p "
        f"FROM {src} t CROSS JOIN ext LEFT JOIN seg ON CAST(t.{c} AS DOUBLE) >= seg.u AND (seg.nu IS NULL OR CAST(t.{c} AS DOUBLE) < seg.nu)) "
    )
    if normal:
        eps = 1e-7 - 2.220446049250313e-16
        pc = f"greatest(least(p, {1 - eps!r}), {eps!r})"
        return body + f"SELECT {key}, CASE WHEN x0 IS NULL THEN NULL ELSE {r6(D.probit_sql(pc))} END AS {c} FROM y"
    return body + f"SELECT {key}, CASE WHEN x0 IS NULL THEN NULL ELSE {r6('p')} END AS {c} FROM y"


@register("quantile_transform", _qt_sql("events", "event_id", "value", normal=True))
def quantile_transform(spark, sf):
    df = D.quantile_transform(table(spark, sf, "events"), ["value"], "normal")
    return _out(df, "event_id", ["value"])


@register("quantile_transform_uniform", _qt_sql("customer", "c_custkey", "c_acctbal", normal=False))
def quantile_transform_uniform(spark, sf):
    df = D.quantile_transform(table(spark, sf, "customer"), ["c_acctbal"], "uniform")
    return _out(df, "c_custkey", ["c_acctbal"])


# ---------------------------------------------------------------- encoding


@register("label_encoder", with_fixture(
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY coalesce(priority_n, 'None')) - 1 AS BIGINT) AS priority_n, "
    "CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS BIGINT) AS o_custkey FROM orders_gappy", OG))
def label_encoder(spark, sf):
    return E.label_encoder(table(spark, sf, OG), ["priority_n", "o_custkey"]).select("o_orderkey", "priority_n", "o_custkey")


@register("ordinal_encoder",
          "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 ELSE "
          "1 + dense_rank() OVER (PARTITION BY o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') ORDER BY o_orderpriority) END AS DOUBLE) "
          "AS o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS o_orderstatus FROM orders")
def ordinal_encoder(spark, sf):
    df = E.ordinal_encoder(table(spark, sf, "orders"), ["o_orderpriority"], order=["5-LOW", "4-NOT SPECIFIED"])
    df = E.ordinal_encoder(df, ["o_orderstatus"])
    return df.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@register("onehot_encoder", with_fixture(
    "SELECT o_orderkey, coalesce(priority_n = '2-HIGH', false) AS \"priority_n_2-HIGH\", "
    "coalesce(priority_n = '3-MEDIUM', false) AS \"priority_n_3-MEDIUM\", "
    "coalesce(priority_n = '4-NOT SPECIFIED', false) AS \"priority_n_4-NOT SPECIFIED\", "
    "coalesce(priority_n = '5-LOW', false) AS \"priority_n_5-LOW\" FROM orders_gappy", OG))
def onehot_encoder(spark, sf):
    df = E.onehot_encoder(table(spark, sf, OG), ["priority_n"])
    return df.select("o_orderkey", *[c for c in df.columns if c.startswith("priority_n_")])


# ---------------------------------------------------------------- pipeline

PIPE_STEPS = [
    Step("fillna_median", ("price_n",)),
    Step("clip_outliers", ("price_n",), {"lower": 0.05, "upper": 0.95}),
    Step("standard_scaler", ("price_n",)),
    Step("derive", (), {"name": "order_year", "expr": "year(o_orderdate)"}),
]

_PIPE = with_fixture(
    ", f AS (SELECT o_orderkey, o_orderdate, coalesce(price_n, (SELECT quantile_cont(price_n, 0.5) FROM orders_gappy)) AS p FROM orders_gappy), "
    "c AS (SELECT o_orderkey, o_orderdate, greatest(b.lo, least(b.hi, p)) AS p FROM f, (SELECT quantile_cont(p, 0.05) AS lo, "
    "quantile_cont(p, 0.95) AS hi FROM f) b) "
    f"SELECT o_orderkey, {r6('(p - (SELECT avg(p) FROM c)) / (SELECT stddev_samp(p) FROM c)')} AS price_n, "
    "CAST(year(o_orderdate) AS INTEGER) AS order_year FROM c", OG).replace(") , f AS", "), f AS")


@register("run_pipeline", _PIPE)
def run_pipeline_q(spark, sf):
    out, _log = run_pipeline(table(spark, sf, OG), PIPE_STEPS)
    return out.select("o_orderkey", rnd(F.col("price_n")).alias("price_n"), "order_year")


@register("run_log",
          "SELECT * FROM (VALUES (1, 'fillna_median', 'success', 'price_n'), (2, 'not_a_step', 'failed', 'price_n')) "
          "AS t(step, name, status, columns)")
def run_log_q(spark, sf):
    steps = [Step("fillna_median", ("price_n",)), Step("not_a_step", ("price_n",)), Step("standard_scaler", ("price_n",))]
    _out_df, log = run_pipeline(table(spark, sf, OG), steps)
    return log.select(F.col("step").cast("int").alias("step"), "name", "status", "columns")
