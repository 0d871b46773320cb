"""Registered datetime-profile and rule queries with oracles."""

from __future__ import annotations

from ..operators import rules as RU
from ..operators import temporal as TM
from .registry import register
from .sqlgen import ident, lit, union
from .tables import table, with_fixture


@register("datetime_range",
          "SELECT 'ts' AS col_name, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_date, "
          "CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400.0) AS BIGINT) AS range_days FROM events")
def datetime_range(spark, sf):
    return TM.datetime_range(table(spark, sf, "events"))


def _freq_sql(src, c):
    return (
        f"WITH s AS (SELECT {c} AS t FROM {src} WHERE {c} IS NOT NULL), "
        "d AS (SELECT CAST(floor((epoch(t) - epoch(lag(t) OVER (ORDER BY t))) / 86400.0) AS BIGINT) AS gap FROM s), "
        "g AS (SELECT gap, count(*) AS c FROM d WHERE gap IS NOT NULL GROUP BY gap), "
        "m AS (SELECT gap FROM g ORDER BY c DESC, gap LIMIT 1) "
        f"SELECT {lit(c)} AS col_name, CASE WHEN m.gap = 1 THEN 'Daily' WHEN m.gap BETWEEN 6 AND 8 THEN 'Weekly' "
        "WHEN m.gap BETWEEN 28 AND 31 THEN 'Monthly' ELSE CAST(m.gap AS VARCHAR) || ' days' END AS frequency, "
        "m.gap AS mode_gap_days, (SELECT round(avg(gap), 2) FROM d WHERE gap IS NOT NULL) AS avg_gap_days FROM m"
    )


@register("datetime_frequency", union([_freq_sql("orders", "o_orderdate"), _freq_sql("events", "ts")]))
def datetime_frequency(spark, sf):
    a = TM.datetime_frequency(table(spark, sf, "orders"), "o_orderdate")
    b = TM.datetime_frequency(table(spark, sf, "events"), "ts")
    return a.unionByName(b)


@register("datetime_activity",
          "WITH c AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) "
          "SELECT 'o_orderdate' AS col_name, (SELECT CAST(d AS VARCHAR) FROM c ORDER BY n DESC, d LIMIT 1) AS peak_date, "
          "(SELECT CAST(max(n) AS BIGINT) FROM c) AS peak_count, (SELECT CAST(d AS VARCHAR) FROM c ORDER BY n, d LIMIT 1) AS low_date, "
          "(SELECT CAST(min(n) AS BIGINT) FROM c) AS low_count")
def datetime_activity(spark, sf):
    return TM.datetime_activity(table(spark, sf, "orders"), "o_orderdate")


PART_COLS = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")]


def _alerts_sql():
    parts = []
    for c, dt in PART_COLS:
        u = f"(SELECT count(DISTINCT {ident(c)}) FROM part)"
        n = "(SELECT count(*) FROM part)"
        if dt == "string":
            parts.append(f"SELECT 'high_cardinality' AS type, {lit(c)} AS col_name, 'High cardinality detected (' || CAST({u} AS VARCHAR) "
                         f"|| ' unique values). May increase model complexity.' AS message WHERE {u} > 50")
        if dt != "double":
            parts.append(f"SELECT 'id_like' AS type, {lit(c)} AS col_name, {lit(RU.MSG_ID_LIKE)} AS message WHERE {u} = {n}")
            parts.append(f"SELECT 'near_unique' AS type, {lit(c)} AS col_name, {lit(RU.MSG_NEAR_UNIQUE)} AS message "
                         f"WHERE {u} <> {n} AND CAST({u} AS DOUBLE) / {n} > 0.95")
    return union(parts)


@register("profile_alerts", _alerts_sql())
def profile_alerts(spark, sf):
    return RU.profile_alerts(table(spark, sf, "part"))


OGC = [("o_orderkey", True), ("o_custkey", True), ("o_orderdate", False), ("price_n", True), ("priority_n", False)]


def _advice_sql():
    parts = []
    for c, numeric in OGC:
        mp = f"round(round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100, 2), 1)"
        u = f"count(DISTINCT {c})"
        gaps = f"(count(*) - count({c}))"
        imp = RU.ADVICE_IMPUTE_NUMERIC if numeric else RU.ADVICE_IMPUTE_OTHER
        idl = "''" if numeric else f"CASE WHEN {u} = count(*) THEN {lit(RU.ADVICE_ID_LIKE)} ELSE '' END"
        parts.append(
            f"SELECT {lit(c)} AS col_name, {mp} AS missing_pct, CAST({u} AS BIGINT) AS unique_count, "
            f"CASE WHEN {gaps} > 0 THEN (CASE WHEN 2 * {gaps} > count(*) THEN {lit(RU.ADVICE_DROP_HIGH_MISSING)} ELSE {lit(imp)} END) "
            f"WHEN {u} = 1 THEN {lit(RU.ADVICE_CONSTANT)} ELSE {idl} END AS suggestion FROM orders_gappy")
    return with_fixture(union(parts), "orders_gappy")


@register("column_advice", _advice_sql())
def column_advice(spark, sf):
    return RU.column_advice(table(spark, sf, "orders_gappy"))


def _table_sql(src, cols):
    """CTEs: one row per column (position, numeric, gaps, distinct), the number of rows, repeated rows."""
    per = union([f"SELECT {i} AS i, {lit(c)} AS c, {str(num).lower()} AS num, count(*) - count({c}) AS gaps, count(DISTINCT {c}) AS u FROM {src}"
                 for i, (c, num) in enumerate(cols)])
    return (f"p AS ({per}), n AS (SELECT count(*) AS r, {len(cols)} AS k FROM {src}), "
            f"dup AS (SELECT (SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS d), "
            "s AS (SELECT CAST(sum(gaps) AS DOUBLE) / max(n.r * n.k) AS share FROM p, n)")


def _insights_sql(src, cols):
    return with_fixture(
        ", " + _table_sql(src, cols) + ", "
        "w AS (SELECT * FROM p ORDER BY gaps DESC, i LIMIT 1), c AS (SELECT count(*) AS n, min_by(c, i) AS first FROM p WHERE u = 1), "
        "t(o, ok, insight) AS ("
        "SELECT 1, true, format('{} rows in {} columns', r, k) FROM n "
        "UNION ALL SELECT 2, w.gaps > 0, format('{} columns have gaps, most of all {} ({}%)', (SELECT count(*) FROM p WHERE gaps > 0), w.c, printf('%.4f', w.gaps * 100.0 / r)) FROM w, n "
        "UNION ALL SELECT 3, w.gaps = 0, 'No column has gaps' FROM w "
        "UNION ALL SELECT 4, d > 0, format('{} rows repeat another ({}%)', d, printf('%.4f', d * 100.0 / r)) FROM dup, n "
        "UNION ALL SELECT 5, d = 0, 'No row repeats another' FROM dup "
        "UNION ALL SELECT 6, true, format('{} numeric and {} other columns', count(*) FILTER (num), count(*) FILTER (NOT num)) FROM p "
        "UNION ALL SELECT 7, c.n > 0, format('{} columns hold a single value, the first is {}', c.n, c.first) FROM c) "
        "SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS idx, insight FROM t WHERE ok", src).replace(") , p AS", "), p AS")


def _suggest_sql(src, cols):
    def rule(o, step, title, impact, where, holds="true", least=1):
        return (f"SELECT {o} AS o, {lit(step)} AS step, {lit(title)} AS title, {impact} AS impact, string_agg(c, ',' ORDER BY i) AS cols, "
                f"count(*) AS n, ({holds}) AND count(*) >= {least} AS ok FROM p WHERE {where}")

    share = "(SELECT share FROM s)"
    rules = union([
        rule(1, "fillna_median", "Fill gaps with the column median", "'medium'", "gaps > 0 AND num"),
        rule(2, "fillna_mean", "Fill gaps with the column mean", "'medium'", "gaps > 0 AND num"),
        rule(3, "fillna_mode", "Fill gaps with the most frequent value", "'medium'", "gaps > 0 AND NOT num"),
        rule(4, "dropna_rows", "Drop rows with gaps", f"CASE WHEN {share} > 0.15 THEN 'high' ELSE 'medium' END", "gaps > 0", f"{share} > 0 AND {share} < 0.3"),
        rule(5, "drop_columns", "Drop columns that are mostly gaps", "'high'", "2 * gaps > (SELECT r FROM n)"),
        "SELECT 6, 'drop_duplicates_all', 'Drop repeated rows', 'medium', 'all', -1, d > 0 FROM dup",
        rule(7, "label_encoder", "Encode categories as numbers", "'high'", "NOT num"),
        rule(8, "standard_scaler", "Bring numbers to one scale", "'medium'", "num", least=2),
    ])
    return with_fixture(
        ", " + _table_sql(src, cols) + f", t AS ({rules}) SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS idx, step AS id, title, "
        "CASE WHEN n < 0 THEN 'the whole table' ELSE CAST(n AS VARCHAR) || ' columns' END AS description, "
        "cols AS affected_columns, impact, step FROM t WHERE ok", src).replace(") , p AS", "), p AS")


_GAP = [("o_orderkey", True), ("price_g", True), ("fixed", False)]
_DUP = [("user_id", True), ("event_type", False), ("d", False)]


@register("data_insights", _insights_sql("orders_gappy", OGC))
def data_insights(spark, sf):
    return RU.data_insights(table(spark, sf, "orders_gappy"))


@register("data_insights_one_gap", _insights_sql("orders_one_gap", _GAP))
def data_insights_one_gap(spark, sf):
    return RU.data_insights(table(spark, sf, "orders_one_gap"))


@register("data_insights_repeated", _insights_sql("events_dup", _DUP))
def data_insights_repeated(spark, sf):
    return RU.data_insights(table(spark, sf, "events_dup"))


@register("suggest_steps", _suggest_sql("orders_gappy", OGC))
def suggest_steps(spark, sf):
    return RU.suggest_steps(table(spark, sf, "orders_gappy"))


@register("suggest_steps_one_gap", _suggest_sql("orders_one_gap", _GAP))
def suggest_steps_one_gap(spark, sf):
    return RU.suggest_steps(table(spark, sf, "orders_one_gap"))


@register("suggest_steps_repeated", _suggest_sql("events_dup", _DUP))
def suggest_steps_repeated(spark, sf):
    return RU.suggest_steps(table(spark, sf, "events_dup"))


@register("available_step_groups", with_fixture(
    "SELECT 'missing_values' AS step_group WHERE EXISTS (SELECT 1 FROM orders_gappy WHERE o_orderkey IS NULL OR o_custkey IS NULL "
    "OR o_orderdate IS NULL OR price_n IS NULL OR priority_n IS NULL) "
    "UNION ALL SELECT 'outliers' UNION ALL SELECT 'scaling' UNION ALL SELECT 'distribution' UNION ALL SELECT 'encoding'", "orders_gappy"))
def available_step_groups(spark, sf):
    return RU.available_step_groups(table(spark, sf, "orders_gappy"))
