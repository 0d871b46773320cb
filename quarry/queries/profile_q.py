"""Registered profiling queries and their DuckDB oracles."""

from __future__ import annotations

from ..operators import profile as P
from ..operators import values as V
from .registry import register
from .sqlgen import ident, lit, pct_sql, r6, union
from .tables import table, with_fixture

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPPY_NUM = LINE_NUM + ["price_n"]
PROBS = [("p1", 0.01), ("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)]


def _numeric_profile_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({ident(c)} AS DOUBLE)"
        qs = ", ".join(f"{r6(f'quantile_cont({x}, {p})')} AS {n}" for n, p in PROBS)
        parts.append(
            f"SELECT {lit(c)} AS col_name, CAST(count({x}) AS BIGINT) AS count, {r6(f'min({x})')} AS min, "
            f"{r6(f'max({x})')} AS max, {r6(f'avg({x})')} AS mean, {r6(f'quantile_cont({x}, 0.5)')} AS median, "
            f"{r6(f'stddev_samp({x})')} AS std, {r6(f'var_samp({x})')} AS variance, {qs}, "
            f"{r6(f'quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)')} AS iqr, "
            f"{r6(f'CASE WHEN avg({x}) <> 0 THEN stddev_samp({x}) / avg({x}) ELSE 0 END')} AS cv, "
            f"CAST(sum(CASE WHEN {x} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros_count, "
            f"{pct_sql(f'sum(CASE WHEN {x} = 0 THEN 1 ELSE 0 END)', f'count({x})')} AS zeros_pct, "
            f"CAST(sum(CASE WHEN {x} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_count, "
            f"{pct_sql(f'sum(CASE WHEN {x} < 0 THEN 1 ELSE 0 END)', f'count({x})')} AS negative_pct, "
            f"{r6(f'avg(power({x} - s.mu, 3)) / power(avg(power({x} - s.mu, 2)), 1.5)')} AS skewness, "
            f"{r6(f'avg(power({x} - s.mu, 4)) / power(avg(power({x} - s.mu, 2)), 2) - 3')} AS kurtosis, "
            f"CAST(sum(CASE WHEN {x} < s.q1 - 1.5 * (s.q3 - s.q1) OR {x} > s.q3 + 1.5 * (s.q3 - s.q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers_count, "
            f"{pct_sql(f'sum(CASE WHEN {x} < s.q1 - 1.5 * (s.q3 - s.q1) OR {x} > s.q3 + 1.5 * (s.q3 - s.q1) THEN 1 ELSE 0 END)', f'count({x})')} AS outliers_pct "
            f"FROM {src} t, (SELECT avg({x}) AS mu, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {src}) s"
        )
    return union(parts)


@register("numeric_profile", _numeric_profile_sql("lineitem", LINE_NUM))
def numeric_profile(spark, sf):
    return P.numeric_profile(table(spark, sf, "lineitem"))


def _summary_sql(src, cols):
    parts = []
    for c in cols:
        x = f"CAST({ident(c)} AS DOUBLE)"
        parts.append(
            f"SELECT {lit(c)} AS col_name, {r6(f'min({x})')} AS min, {r6(f'max({x})')} AS max, {r6(f'avg({x})')} AS mean, "
            f"{r6(f'quantile_cont({x}, 0.5)')} AS median, {r6(f'stddev_samp({x})')} AS std, "
            f"{r6(f'quantile_cont({x}, 0.25)')} AS q25, {r6(f'quantile_cont({x}, 0.75)')} AS q75 FROM {src}"
        )
    return union(parts)


ORDERS_GAPPY_NUM = ["o_orderkey", "o_custkey", "price_n"]


@register("numeric_summary", with_fixture(_summary_sql("orders_gappy", ORDERS_GAPPY_NUM), "orders_gappy"))
def numeric_summary(spark, sf):
    return P.numeric_summary(table(spark, sf, "orders_gappy"))


def _moments_sql(src, cols):
    parts = []
    for c in cols:
        x = f"CAST({ident(c)} AS DOUBLE)"
        parts.append(
            f"SELECT {lit(c)} AS col_name, "
            f"{r6(f'avg(power({x} - s.mu, 3)) / power(avg(power({x} - s.mu, 2)), 1.5)')} AS skewness, "
            f"{r6(f'avg(power({x} - s.mu, 4)) / power(avg(power({x} - s.mu, 2)), 2) - 3')} AS kurtosis "
            f"FROM {src} t, (SELECT avg({x}) AS mu FROM {src}) s"
        )
    return union(parts)


@register("shape_moments", _moments_sql("events", ["event_id", "user_id", "value"]))
def shape_moments(spark, sf):
    return P.shape_moments(table(spark, sf, "events"))


def _outlier_sql(src, cols, k=1.5):
    parts = []
    for c in cols:
        x = f"CAST({ident(c)} AS DOUBLE)"
        cond = f"{x} < s.q1 - {k} * (s.q3 - s.q1) OR {x} > s.q3 + {k} * (s.q3 - s.q1)"
        parts.append(
            f"SELECT {lit(c)} AS col_name, CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS outliers_count, "
            f"{pct_sql(f'sum(CASE WHEN {cond} THEN 1 ELSE 0 END)', f'count({x})')} AS outliers_pct "
            f"FROM {src} t, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {src}) s"
        )
    return union(parts)


@register("iqr_outlier_counts", with_fixture(_outlier_sql("lineitem_gappy", GAPPY_NUM), "lineitem_gappy"))
def iqr_outlier_counts(spark, sf):
    return P.iqr_outlier_counts(table(spark, sf, "lineitem_gappy"))


def _hist_sql(src, cols, bins=20):
    parts = []
    for c in cols:
        x = f"CAST({ident(c)} AS DOUBLE)"
        rng = (f"SELECT CASE WHEN min({x}) IS NULL THEN 0.0 WHEN min({x}) = max({x}) THEN min({x}) - 0.5 ELSE min({x}) END AS lo, "
               f"CASE WHEN max({x}) IS NULL THEN 1.0 WHEN min({x}) = max({x}) THEN max({x}) + 0.5 ELSE max({x}) END AS hi FROM {src}")
        w = f"((r.hi - r.lo) / {float(bins)})"
        raw = f"least(greatest(CAST(floor(({x} - r.lo) * ({float(bins)} / (r.hi - r.lo))) AS INTEGER), 0), {bins - 1})"
        edge = f"(r.lo + CAST({raw} AS DOUBLE) * {w})"
        nxt = f"(CASE WHEN {raw} + 1 = {bins} THEN r.hi ELSE r.lo + CAST({raw} + 1 AS DOUBLE) * {w} END)"
        idx = (f"CASE WHEN {x} < {edge} THEN {raw} - 1 WHEN {x} >= {nxt} AND {raw} <> {bins - 1} THEN {raw} + 1 "
               f"ELSE {raw} END")
        parts.append(
            f"SELECT {lit(c)} AS col_name, CAST(g.b AS INTEGER) AS bin, {r6(f'r.lo + CAST(g.b AS DOUBLE) * {w}')} AS bin_start, "
            f"{r6(f'CASE WHEN g.b = {bins - 1} THEN r.hi ELSE r.lo + CAST(g.b + 1 AS DOUBLE) * {w} END')} AS bin_end, "
            f"CAST(coalesce(cnt.n, 0) AS BIGINT) AS count "
            f"FROM ({rng}) r CROSS JOIN range(0, {bins}) g(b) LEFT JOIN "
            f"(SELECT {idx} AS bin, count(*) AS n FROM {src} t, ({rng}) r WHERE {x} IS NOT NULL GROUP BY 1) cnt ON cnt.bin = g.b"
        )
    return union(parts)


@register("histogram", with_fixture(_hist_sql("lineitem_gappy", ["l_quantity", "l_discount", "price_n"]), "lineitem_gappy"))
def histogram(spark, sf):
    return V.histogram(table(spark, sf, "lineitem_gappy"), ["l_quantity", "l_discount", "price_n"], bins=20)


def _top_sql(src, cols, k=5):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT {lit(c)} AS col_name, CAST(rank AS INTEGER) AS rank, substr(value, 1, 50) AS value, CAST(cnt AS BIGINT) AS count, "
            f"{pct_sql('cnt', 'total')} AS pct FROM (SELECT value, cnt, sum(cnt) OVER () AS total, "
            f"row_number() OVER (ORDER BY cnt DESC, value) AS rank FROM (SELECT CAST({ident(c)} AS VARCHAR) AS value, count(*) AS cnt "
            f"FROM {src} WHERE {ident(c)} IS NOT NULL GROUP BY 1)) WHERE rank <= {k}"
        )
    return union(parts)


@register("top_values", _top_sql("part", ["p_name", "p_brand", "p_type"]))
def top_values(spark, sf):
    return V.top_values(table(spark, sf, "part"), k=5)


def _cat_sql(src, cols):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT {lit(c)} AS col_name, CAST(count(*) AS BIGINT) AS unique_categories, "
            f"CAST(sum(CASE WHEN CAST(cnt AS DOUBLE) / total < 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS rare_count, "
            f"max(cnt) / max(total) > 0.5 AS dominant_category, "
            f"CASE WHEN count(*) > 1 THEN round(CAST(max(cnt) AS DOUBLE) / min(cnt), 2) ELSE 1.0 END AS imbalance_ratio "
            f"FROM (SELECT cnt, sum(cnt) OVER () AS total FROM (SELECT {ident(c)} AS v, count(*) AS cnt FROM {src} "
            f"WHERE {ident(c)} IS NOT NULL GROUP BY 1))"
        )
    return union(parts)


@register("categorical_profile", with_fixture(_cat_sql("docs_labelled", ["text", "lang"]), "docs_labelled"))
def categorical_profile(spark, sf):
    return V.categorical_profile(table(spark, sf, "docs_labelled"))


ORDERS_GAPPY_COLS = [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
                     ("o_orderdate", "timestamp_ntz", "datetime"), ("price_n", "double", "numeric"),
                     ("priority_n", "string", "categorical")]


def _colprof_sql(src, cols):
    parts = []
    for c, dt, cls in cols:
        u = f"count(DISTINCT {ident(c)})"
        parts.append(
            f"SELECT {lit(c)} AS col_name, {lit(dt)} AS dtype, {lit(cls)} AS col_class, "
            f"CAST(count(*) - count({ident(c)}) AS BIGINT) AS missing_count, "
            f"coalesce({pct_sql(f'count(*) - count({ident(c)})', 'count(*)')}, 0.0) AS missing_pct, "
            f"CAST({u} AS BIGINT) AS unique_count, "
            f"CASE WHEN {u} < 10 THEN 'Low' WHEN {u} < 50 THEN 'Medium' ELSE 'High' END AS cardinality FROM {src}"
        )
    return union(parts)


@register("column_profile", with_fixture(_colprof_sql("orders_gappy", ORDERS_GAPPY_COLS), "orders_gappy"))
def column_profile(spark, sf):
    return P.column_profile(table(spark, sf, "orders_gappy"))


_OG = [c for c, _, _ in ORDERS_GAPPY_COLS]
_OG_MISS = " + ".join(f"(count(*) - count({c}))" for c in _OG)
_OG_DUP = ("(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS d, sum(n) AS tot FROM "
           f"(SELECT count(*) AS n FROM orders_gappy GROUP BY ALL_COLS))").replace("ALL_COLS", ", ".join(_OG))
_OG_CONST = " + ".join(f"(CASE WHEN count(DISTINCT {c}) = 1 THEN 1 ELSE 0 END)" for c in _OG)
_OG_HIGH = " + ".join(f"(CASE WHEN count(*) - count({c}) > count(*) * 0.5 THEN 1 ELSE 0 END)" for c in _OG)

DATASET_OVERVIEW_SQL = with_fixture(
    f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS columns, CAST({_OG_MISS} AS BIGINT) AS total_missing_cells, "
    f"round(CAST({_OG_MISS} AS DOUBLE) / (count(*) * 5) * 100, 6) AS missing_pct, "
    f"round((1 - CAST({_OG_MISS} AS DOUBLE) / (count(*) * 5)) * 100, 1) AS quality_score, "
    f"CAST({_OG_HIGH} AS BIGINT) AS high_missing_cols, CAST(3 AS BIGINT) AS numeric_count, CAST(1 AS BIGINT) AS categorical_count, "
    f"CAST(1 AS BIGINT) AS datetime_count, 60.0 AS numeric_pct, 20.0 AS categorical_pct, 20.0 AS datetime_pct, "
    f"CAST({_OG_CONST} AS BIGINT) AS constant_columns, max(dup.d) AS duplicate_rows, "
    f"round(CAST(max(dup.d) AS DOUBLE) / count(*) * 100, 2) AS duplicate_rows_pct "
    f"FROM orders_gappy, {_OG_DUP} dup",
    "orders_gappy",
)


@register("dataset_overview", DATASET_OVERVIEW_SQL)
def dataset_overview(spark, sf):
    return P.dataset_overview(table(spark, sf, "orders_gappy"))


@register("duplicate_rows", with_fixture(
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, "
    "round(CAST(coalesce(sum(n - 1), 0) AS DOUBLE) / sum(n) * 100, 2) AS duplicate_rows_pct "
    "FROM (SELECT count(*) AS n FROM events_dup GROUP BY user_id, event_type, d)", "events_dup"))
def duplicate_rows(spark, sf):
    return P.duplicate_rows(table(spark, sf, "events_dup"))


_DL = ["doc_id", "text", "lang", "n_chars", "quality", "toxic"]
_DL_NULLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _DL)


@register("row_missingness", with_fixture(
    f"SELECT CAST(sum(CASE WHEN ({_DL_NULLS}) / 6.0 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS rows_50pct_missing, "
    f"CAST(sum(CASE WHEN ({_DL_NULLS}) / 6.0 > 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS rows_80pct_missing, "
    f"CAST({' + '.join(f'(CASE WHEN avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 THEN 1 ELSE 0 END)' for c in _DL)} AS BIGINT) "
    f"AS cols_50pct_missing FROM docs_labelled", "docs_labelled"))
def row_missingness(spark, sf):
    return P.row_missingness(table(spark, sf, "docs_labelled"))


@register("table_bytes", union([
    "SELECT 'o_orderkey' AS col_name, CAST(count(*) * 8 AS BIGINT) AS bytes FROM orders",
    "SELECT 'o_custkey' AS col_name, CAST(count(*) * 8 AS BIGINT) AS bytes FROM orders",
    "SELECT 'o_orderstatus' AS col_name, CAST(coalesce(sum(strlen(o_orderstatus)), 0) AS BIGINT) AS bytes FROM orders",
    "SELECT 'o_totalprice' AS col_name, CAST(count(*) * 8 AS BIGINT) AS bytes FROM orders",
    "SELECT 'o_orderdate' AS col_name, CAST(count(*) * 8 AS BIGINT) AS bytes FROM orders",
    "SELECT 'o_orderpriority' AS col_name, CAST(coalesce(sum(strlen(o_orderpriority)), 0) AS BIGINT) AS bytes FROM orders",
]))
def table_bytes(spark, sf):
    return P.table_bytes(table(spark, sf, "orders"))


def _corr_sql(src, cols, nd=3):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT {lit(a)} AS col1, {lit(b)} AS col2, round(corr(CAST({ident(a)} AS DOUBLE), "
                         f"CAST({ident(b)} AS DOUBLE)), {nd}) AS correlation FROM {src}")
    return union(parts)


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_n"]


@register("correlation_matrix", with_fixture(_corr_sql("lineitem_gappy", CORR_COLS), "lineitem_gappy"))
def correlation_matrix(spark, sf):
    return P.correlation_matrix(table(spark, sf, "lineitem_gappy"), CORR_COLS)


def _high_corr_sql(src, cols, thr=0.8, top=10):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i + 1:], start=i + 1):
            parts.append(f"SELECT {lit(a)} AS col1, {lit(b)} AS col2, round(corr(CAST({ident(a)} AS DOUBLE), "
                         f"CAST({ident(b)} AS DOUBLE)), 3) AS correlation, {i} AS i, {j} AS j FROM {src}")
    return (f"SELECT col1, col2, correlation FROM ({union(parts)}) WHERE abs(correlation) > {thr} "
            f"ORDER BY abs(correlation) DESC, i, j LIMIT {top}")


@register("high_corr_pairs", with_fixture(_high_corr_sql("lineitem_gappy", GAPPY_NUM), "lineitem_gappy"))
def high_corr_pairs(spark, sf):
    return P.high_corr_pairs(table(spark, sf, "lineitem_gappy"), 0.8, 10, GAPPY_NUM)


def _zero_sql(src, cols, thr):
    parts = [f"SELECT {lit(c)} AS col_name, round(sum(CASE WHEN {ident(c)} = 0 THEN 1 ELSE 0 END) / count(*), 6) AS zero_share "
             f"FROM {src}" for c in cols]
    return f"SELECT * FROM ({union(parts)}) WHERE zero_share > {thr}"


@register("zero_heavy_columns", _zero_sql("lineitem", LINE_NUM, 0.05))
def zero_heavy_columns(spark, sf):
    return P.zero_heavy_columns(table(spark, sf, "lineitem"), 0.05)
