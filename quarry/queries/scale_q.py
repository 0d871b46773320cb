"""Keys that force the paths of large tables on small ones: many counting rounds, many buckets; and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distribution as D
from ..operators import mlprep as M
from ..operators import profile as P
from ..operators.encode import label_encoder
from ..plans.fitted import transform
from ..plans.guards import written
from ..plans.ordered import backward_fill, forward_fill
from ..plans.ordered import page as page_op
from ..plans.quantiles import column_quantiles, exact_quantiles, long_format
from ..plans.runner import Step, run_pipeline, run_previews, run_summary
from .ml_q import _SPLIT_TIME
from .registry import register
from .tables import table, with_fixture

ROWS_PER_BUCKET = 500
_FITS = {"boxcox": D.fit_boxcox_transform, "yeojohnson": D.fit_yeojohnson_transform}


def _quantiles_sql():
    probs = "list_transform(range(0, 1001), lambda j: j / 1000.0)"
    one = ("SELECT '{c}' AS key, unnest(range(0, 1001)) AS pi, unnest(list_transform(" + probs + ", lambda p: p)) AS p, "
           "n, unnest(s) AS q FROM (SELECT count({c}) AS n, list({c} ORDER BY {c}) FILTER ({c} IS NOT NULL) AS v FROM lineitem_gappy), "
           "LATERAL (SELECT list_transform(" + probs + ", lambda p: v[CAST(floor((n - 1) * p) AS BIGINT) + 1] + "
           "(v[least(CAST(floor((n - 1) * p) AS BIGINT) + 2, n)] - v[CAST(floor((n - 1) * p) AS BIGINT) + 1]) * ((n - 1) * p - floor((n - 1) * p))) AS s)")
    parts = " UNION ALL ".join(f"({one.format(c=c)})" for c in ("price_n", "l_tax", "l_discount"))
    return with_fixture(f"SELECT key, CAST(pi AS INTEGER) AS pi, n, round(q, 6) AS q FROM ({parts})", "lineitem_gappy")


@register("quantiles_many_rounds", _quantiles_sql())
def quantiles_many_rounds(spark, sf):
    long = long_format(table(spark, sf, "lineitem_gappy"), ["price_n", "l_tax", "l_discount"])
    out = exact_quantiles(long, [j / 1000 for j in range(1001)], limit=20)
    return out.select("key", "pi", "n", F.round("q", 6).alias("q"))


_FILL = "SELECT o_orderkey, {f}(price_n IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN {w}) AS price_n, {f}(priority_n IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN {w}) AS priority_n FROM orders_gappy"


@register("fillna_ffill_many_buckets", with_fixture(_FILL.format(f="last_value", w="UNBOUNDED PRECEDING AND CURRENT ROW"), "orders_gappy"))
def fillna_ffill_many_buckets(spark, sf):
    df = table(spark, sf, "orders_gappy").select("o_orderkey", "price_n", "priority_n")
    return forward_fill(df, ["price_n", "priority_n"], ["o_orderkey"], rows_per_bucket=ROWS_PER_BUCKET)


@register("fillna_bfill_many_buckets", with_fixture(_FILL.format(f="first_value", w="CURRENT ROW AND UNBOUNDED FOLLOWING"), "orders_gappy"))
def fillna_bfill_many_buckets(spark, sf):
    df = table(spark, sf, "orders_gappy").select("o_orderkey", "price_n", "priority_n")
    return backward_fill(df, ["price_n", "priority_n"], ["o_orderkey"], rows_per_bucket=ROWS_PER_BUCKET)


@register("fillna_bfill_whole", with_fixture(_FILL.format(f="first_value", w="CURRENT ROW AND UNBOUNDED FOLLOWING"), "orders_gappy"))
def fillna_bfill_whole(spark, sf):
    df = table(spark, sf, "orders_gappy").select("o_orderkey", "price_n", "priority_n")
    return backward_fill(df, ["price_n", "priority_n"], ["o_orderkey"])


@register("split_time_many_buckets", _SPLIT_TIME)
def split_time_many_buckets(spark, sf):
    out = M.split_time(table(spark, sf, "orders"), "o_orderdate", 0.2, tiebreak=["o_orderkey"], rows_per_bucket=ROWS_PER_BUCKET)
    return out.select("o_orderkey", "split")


@register("page_many_buckets",
          "SELECT o_orderkey, row_number, CAST(count(*) OVER () AS BIGINT) AS total_rows, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS total_pages FROM "
          "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders) "
          "QUALIFY row_number > 5000 AND row_number <= 5050")
def page_many_buckets(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return page_op(df, 101, 50, ["o_orderdate", "o_orderkey"], rows_per_bucket=ROWS_PER_BUCKET).drop("o_orderdate")


@register("boxcox_given_lambda", "SELECT event_id, round((power(value, 0.25) - 1) / 0.25, 6) AS value FROM events")
def boxcox_given_lambda(spark, sf):
    df = transform("boxcox_transform", table(spark, sf, "events"), ["value"], lambdas={"value": 0.25})
    return df.select("event_id", F.round("value", 6).alias("value"))


@register("yeojohnson_given_lambda",
          "WITH y AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN (power(c_acctbal + 1, 0.5) - 1) / 0.5 "
          "ELSE -(power(1 - c_acctbal, 1.5) - 1) / 1.5 END AS y FROM customer) "
          "SELECT c_custkey, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS c_acctbal FROM y")
def yeojohnson_given_lambda(spark, sf):
    df = transform("yeojohnson_transform", table(spark, sf, "customer"), ["c_acctbal"], lambdas={"c_acctbal": 0.5})
    return df.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@register("power_fit_is_a_maximum",
          "SELECT 'boxcox' AS kind, (SELECT count(value) FROM events) AS n, true AS below, true AS above "
          "UNION ALL SELECT 'yeojohnson', (SELECT count(c_acctbal) FROM customer), true, true")
def power_fit_is_a_maximum(spark, sf):
    """Whether the likelihood at the fitted lambda is not below that at lambda - 1e-3 and lambda + 1e-3."""
    out = []
    for kind, name, c in (("boxcox", "events", "value"), ("yeojohnson", "customer", "c_acctbal")):
        df = table(spark, sf, name)
        fit = _FITS[kind](df, [c]).values[c]
        at = [D.log_likelihood(df, c, fit["lambda"] + d, kind, fit.get("shift", 0.0)).first()["llf"] for d in (0.0, -1e-3, 1e-3)]
        out.append((kind, df.where(F.col(c).isNotNull()).count(), at[0] >= at[1], at[0] >= at[2]))
    return spark.createDataFrame(out, "kind string, n long, below boolean, above boolean")


_FILLED = "SELECT '{tag}' AS selector, o_orderkey, round({v}, 6) AS price_n FROM orders_gappy"


@register("column_selectors", with_fixture(
    " UNION ALL ".join(f"({_FILLED.format(tag=t, v='coalesce(price_n, avg(price_n) OVER ())' if filled else 'price_n')})" for t, filled in
                       (("all", True), ("exclude", False), ("exclude other", True), ("all columns", True), ("all but target", False))), "orders_gappy"))
def column_selectors(spark, sf):
    df = table(spark, sf, "orders_gappy")
    out = None
    for tag, step in (
        ("all", Step("fillna_mean", (), mode="all")), ("exclude", Step("fillna_mean", ("price_n",), mode="exclude")),
        ("exclude other", Step("fillna_mean", ("o_custkey",), mode="exclude")), ("all columns", Step("fillna_mean", ("__ALL_COLUMNS__",))),
        ("all but target", Step("fillna_mean", ("__ALL_EXCEPT_TARGET__",), target="price_n")),
    ):
        one = run_pipeline(df, [step])[0].select(F.lit(tag).alias("selector"), "o_orderkey", F.round("price_n", 6).alias("price_n"))
        out = one if out is None else out.unionByName(one)
    return out


def _run(spark, sf):
    df = table(spark, sf, "orders_gappy")
    return (df, *run_pipeline(df, [Step("dropna_rows", ("price_n",)), Step("drop_columns", ("o_custkey",)), Step("no_such_step", ("price_n",))]))


@register("run_summary", with_fixture(
    "SELECT CAST(3 AS BIGINT) AS total_steps, CAST(2 AS BIGINT) AS success, CAST(1 AS BIGINT) AS failed, count(*) AS original_rows, 5 AS original_columns, "
    "count(*) FILTER (price_n IS NOT NULL AND priority_n IS NOT NULL) AS final_rows, 4 AS final_columns FROM orders_gappy", "orders_gappy"))
def run_summary_key(spark, sf):
    df, result, log = _run(spark, sf)
    return run_summary(df, result, log).withColumns({"original_rows": F.col("original_rows").cast("long"), "final_rows": F.col("final_rows").cast("long")})


_CELLS = ("SELECT '{side}' AS side, CAST(position AS INTEGER) AS position, col_name, value FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS position, "
          "CAST(o_orderkey AS VARCHAR) AS o_orderkey, {more}priority_n FROM orders_gappy {where} ORDER BY 1 LIMIT 10) "
          "UNPIVOT INCLUDE NULLS (value FOR col_name IN (o_orderkey, {names}priority_n))")


@register("run_previews", with_fixture(
    "(" + _CELLS.format(side="before", more="CAST(o_custkey AS VARCHAR) AS o_custkey, ", names="o_custkey, ", where="") + ") UNION ALL ("
    + _CELLS.format(side="after", more="", names="", where="WHERE price_n IS NOT NULL AND priority_n IS NOT NULL") + ")", "orders_gappy"))
def run_previews_key(spark, sf):
    df, result, _ = _run(spark, sf)
    return run_previews(df, result, ["o_orderkey"]).where("col_name NOT IN ('price_n', 'o_orderdate')")


@register("column_profile_approx",
          "SELECT 'o_orderkey' AS col_name, true AS close UNION ALL SELECT 'o_custkey', true UNION ALL SELECT 'o_orderstatus', true UNION ALL "
          "SELECT 'o_totalprice', true UNION ALL SELECT 'o_orderdate', true UNION ALL SELECT 'o_orderpriority', true")
def column_profile_approx(spark, sf):
    """Whether each sketched distinct count is within 15 % of the exact one."""
    df = table(spark, sf, "orders")
    a = P.column_profile(df, distinct="approx").select("col_name", F.col("unique_count").alias("a"))
    b = P.column_profile(df).select("col_name", F.col("unique_count").alias("b"))
    return a.join(b, "col_name").select("col_name", (F.abs(F.col("a") - F.col("b")) <= 0.15 * F.col("b")).alias("close"))


@register("names_that_clash", with_fixture(
    "SELECT o_orderkey AS digest, o_custkey AS \"_bk\", round(last_value(price_n IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS \"first\", "
    "CAST(dense_rank() OVER (ORDER BY coalesce(priority_n, 'None')) - 1 AS BIGINT) AS \"value\", CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS BIGINT) AS \"code\", "
    "CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey) <= CAST(ceil(count(*) OVER () * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS split "
    "FROM orders_gappy", "orders_gappy"))
def names_that_clash(spark, sf):
    """Columns named like the helpers inside ordered fills, dictionaries (beyond the broadcast bound too) and splits."""
    df = table(spark, sf, "orders_gappy").selectExpr("o_orderkey AS digest", "o_custkey AS _bk", "price_n AS first", "priority_n AS value", "o_custkey AS code")
    # the fits that follow read their rows several times: what was shuffled for them is written once
    df = written(forward_fill(df, ["first"], ["digest"], rows_per_bucket=ROWS_PER_BUCKET))
    df = written(label_encoder(label_encoder(df, ["value"]), ["code"], max_bytes=0))
    out = M.split_random(df, "digest", 0.2, 42, rows_per_bucket=ROWS_PER_BUCKET)
    return out.select("digest", "_bk", F.round("first", 6).alias("first"), "value", "code", "split")


_ODD = ("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 7 = 0 THEN CAST('Infinity' AS DOUBLE) "
        "WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders")
_ODD_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


@register("quantiles_nan_inf",
          f"WITH odd AS ({_ODD}), v AS (SELECT list(x ORDER BY x) AS v, count(*) AS n FROM odd WHERE x IS NOT NULL AND NOT isnan(x)), "
          f"p AS (SELECT unnest([{', '.join(map(str, _ODD_PROBS))}]) AS p), "
          "s AS (SELECT p, (n - 1) * p - floor((n - 1) * p) AS f, v[CAST(floor((n - 1) * p) AS BIGINT) + 1] AS a, v[least(CAST(floor((n - 1) * p) AS BIGINT) + 2, n)] AS b FROM v, p), "
          "q AS (SELECT p, CASE WHEN f = 0 OR a = b THEN a ELSE a + (b - a) * f END AS q FROM s) "
          "SELECT CAST(p AS DOUBLE) AS p, isinf(q) AS infinite, CASE WHEN NOT isinf(q) THEN round(q, 6) END AS q FROM q")
def quantiles_nan_inf(spark, sf):
    """NaN counts as missing and infinite values keep their rank."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    found = column_quantiles(spark.sql(_ODD), ["x"], _ODD_PROBS)["x"]
    rows = spark.createDataFrame([(p, float(v)) for p, v in zip(_ODD_PROBS, found)], "p double, v double")
    infinite = F.abs("v") == float("inf")
    return rows.select("p", infinite.alias("infinite"), F.when(~infinite, F.round("v", 6)).alias("q"))
