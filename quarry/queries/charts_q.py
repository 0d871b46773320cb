"""Registered chart-data queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import ts_text
from ..operators import charts as C
from ..operators import reduced as R
from .registry import register
from .sqlgen import r6, union
from .tables import table


@register("chart_bar", "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2")
def chart_bar(spark, sf):
    df = C.chart_bar(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus")
    return df.withColumn("y", F.round("y", 2))


@register("chart_pie", "SELECT l_returnflag, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1")
def chart_pie(spark, sf):
    return C.chart_pie(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity").withColumn("value", F.round("value", 2))


@register("chart_pie_count", "SELECT o_orderstatus, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def chart_pie_count(spark, sf):
    return C.chart_pie(table(spark, sf, "orders"), "o_orderstatus")


@register("chart_line", "SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_totalprice, o_orderstatus FROM orders")
def chart_line(spark, sf):
    df = C.chart_line(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus")
    return df.withColumn("o_orderdate", ts_text(F.col("o_orderdate")))


@register("chart_scatter", "SELECT value, user_id, event_type FROM events")
def chart_scatter(spark, sf):
    return C.chart_scatter(table(spark, sf, "events"), "value", "user_id", "event_type")


def _hist_by_sql(bins=10):
    rng = ("SELECT l_returnflag AS g, CASE WHEN min(l_quantity) = max(l_quantity) THEN min(l_quantity) - 0.5 ELSE min(l_quantity) END AS lo, "
           "CASE WHEN min(l_quantity) = max(l_quantity) THEN max(l_quantity) + 0.5 ELSE max(l_quantity) END AS hi FROM lineitem GROUP BY 1")
    x = "l_quantity"
    w = f"((r.hi - r.lo) / {float(bins)})"
    raw = f"least(greatest(CAST(floor(({x} - r.lo) * ({float(bins)} / (r.hi - r.lo))) AS INTEGER), 0), {bins - 1})"
    edge = f"(r.lo + CAST({raw} AS DOUBLE) * {w})"
    nxt = f"(CASE WHEN {raw} + 1 = {bins} THEN r.hi ELSE r.lo + CAST({raw} + 1 AS DOUBLE) * {w} END)"
    idx = f"CASE WHEN {x} < {edge} THEN {raw} - 1 WHEN {x} >= {nxt} AND {raw} <> {bins - 1} THEN {raw} + 1 ELSE {raw} END"
    return (
        f"SELECT 'l_quantity' AS col_name, r.g AS l_returnflag, CAST(gg.b AS INTEGER) AS bin, {r6(f'r.lo + CAST(gg.b AS DOUBLE) * {w}')} AS bin_start, "
        f"{r6(f'CASE WHEN gg.b = {bins - 1} THEN r.hi ELSE r.lo + CAST(gg.b + 1 AS DOUBLE) * {w} END')} AS bin_end, "
        f"CAST(coalesce(cnt.n, 0) AS BIGINT) AS count FROM ({rng}) r CROSS JOIN range(0, {bins}) gg(b) LEFT JOIN "
        f"(SELECT r.g, {idx} AS bin, count(*) AS n FROM lineitem t JOIN ({rng}) r ON t.l_returnflag = r.g GROUP BY 1, 2) cnt "
        "ON cnt.bin = gg.b AND cnt.g = r.g"
    )


@register("chart_histogram", _hist_by_sql())
def chart_histogram(spark, sf):
    return C.chart_histogram(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", bins=10)


_BOX = (
    "WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, "
    "quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1), "
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q) "
    "SELECT f.o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(lf, 6) AS lower_fence, "
    "round(uf, 6) AS upper_fence, round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max, "
    "round(min(CASE WHEN o_totalprice >= lf THEN o_totalprice END), 6) AS whisker_low, "
    "round(max(CASE WHEN o_totalprice <= uf THEN o_totalprice END), 6) AS whisker_high, "
    "CAST(sum(CASE WHEN o_totalprice < lf OR o_totalprice > uf THEN 1 ELSE 0 END) AS BIGINT) AS outliers "
    "FROM orders o JOIN f ON o.o_orderpriority = f.o_orderpriority GROUP BY f.o_orderpriority, q1, median, q3, lf, uf"
)


@register("chart_box", _BOX)
def chart_box(spark, sf):
    return C.chart_box(table(spark, sf, "orders"), "o_totalprice", x="o_orderpriority")


_LTTB = (
    "WITH p AS (SELECT o_orderstatus AS g, o_orderdate AS x, o_totalprice AS y FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL), "
    "f AS (SELECT g, min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi, CAST(epoch_us(max(x)) - epoch_us(min(x)) AS DOUBLE) AS w FROM p GROUP BY 1), "
    "s AS (SELECT p.*, f.* EXCLUDE (g), CAST(epoch_us(x) - epoch_us(xlo) AS DOUBLE) AS pos, CASE WHEN w > 0 THEN "
    "least(CAST(floor(CAST(epoch_us(x) - epoch_us(xlo) AS DOUBLE) * 200.0 / w) AS INTEGER), 199) ELSE 0 END AS b FROM p JOIN f USING (g)), "
    "e AS (SELECT g, min(xlo) AS xlo, min(xhi) AS xhi, min(ylo) AS ylo, min(yhi) AS yhi, min(w) AS w, min(y) FILTER (x = xlo) AS fy, "
    "max(y) FILTER (x = xhi) AS ly, min(x) FILTER (y = ylo) AS lx, max(x) FILTER (y = yhi) AS hx FROM s GROUP BY 1), "
    "m AS (SELECT g, b, avg(pos) AS mx, avg(y) AS my FROM s GROUP BY 1, 2), "
    "n AS (SELECT m.g, m.b, coalesce(lag(mx) OVER o, 0.0) AS px, coalesce(lag(my) OVER o, e.fy) AS py, coalesce(lead(mx) OVER o, e.w) AS nx, "
    "coalesce(lead(my) OVER o, e.ly) AS ny FROM m JOIN e USING (g) WINDOW o AS (PARTITION BY m.g ORDER BY m.b)), "
    "t AS (SELECT s.g, x, y, row_number() OVER (PARTITION BY s.g, s.b ORDER BY abs((px - nx) * (y - py) - (px - pos) * (ny - py)) DESC, x DESC, y DESC) AS r "
    "FROM s JOIN n ON n.g = s.g AND n.b = s.b), "
    "u AS (SELECT g, x, y FROM t WHERE r = 1 UNION SELECT g, xlo, fy FROM e UNION SELECT g, xhi, ly FROM e UNION SELECT g, lx, ylo FROM e UNION SELECT g, hx, yhi FROM e) "
    "SELECT g AS o_orderstatus, strftime(x, '%Y-%m-%d %H:%M:%S') AS o_orderdate, y AS o_totalprice FROM u"
)


@register("chart_line_reduced", _LTTB)
def chart_line_reduced(spark, sf):
    df = R.chart_line_reduced(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus", points=200)
    return df.withColumn("o_orderdate", ts_text(F.col("o_orderdate")))


def _cells_sql(src, x, y, leaf, depth):
    """The leaves of the quadtree, each level counted from the points themselves."""
    def slot(c, level):
        return (f"CASE WHEN hi_{c} > lo_{c} THEN least(CAST(floor(({c} - lo_{c}) * {float(1 << depth)} / (hi_{c} - lo_{c})) AS INTEGER), "
                f"{(1 << depth) - 1}) ELSE 0 END >> {depth - level}")
    levels = union([f"SELECT CAST({k} AS INTEGER) AS level, {slot('x', k)} AS ix, {slot('y', k)} AS iy, count(*) AS n FROM p, f GROUP BY 1, 2, 3"
                    for k in range(depth + 1)])
    edges = ", ".join(f"round(lo_{c} + (c.i{c} + {k}) * (hi_{c} - lo_{c}) / power(2.0, c.level), 6) AS {c}_{n}"
                      for c in ("x", "y") for k, n in ((0, "from"), (1, "to")))
    return (f"WITH p AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), "
            "f AS (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM p), "
            f"c AS ({levels}) SELECT c.level, {edges}, CAST(c.n AS BIGINT) AS count FROM f, c LEFT JOIN c AS up "
            "ON up.level = c.level - 1 AND up.ix = c.ix >> 1 AND up.iy = c.iy >> 1 "
            f"WHERE (c.n <= {leaf} OR c.level = {depth}) AND (c.level = 0 OR up.n > {leaf})")


@register("chart_scatter_cells", _cells_sql("lineitem", "l_quantity", "l_extendedprice", 200, 7))
def chart_scatter_cells(spark, sf):
    return R.chart_scatter_cells(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", leaf=200, depth=7)
