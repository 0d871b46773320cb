"""Registered queries over stored profile states: ``orders`` profiled as two parts and merged."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import grown as G
from ..session import checkpoint_dir
from .profile_q import ORDERS_GAPPY_COLS, ORDERS_GAPPY_NUM, _colprof_sql, _hist_sql, _numeric_profile_sql, _top_sql
from .registry import register
from .tables import table, with_fixture


def two_parts(spark, sf) -> str:
    """A state of ``orders_gappy`` in two parts, as if the orders since 1996 had been appended."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/profile-{uuid.uuid4().hex}"
    df = table(spark, sf, "orders_gappy")
    late = F.coalesce(F.year("o_orderdate") >= 1996, F.lit(False))
    G.add_part(df.where(~late), path, "before-1996")
    G.add_part(df.where(late), path, "since-1996")
    return path


#: Of the variance (about 1e10) the places behind the point are beyond a double's precision.
@register("numeric_profile_merged", with_fixture(
    f"SELECT * REPLACE (round(variance, 0) AS variance, round(std, 3) AS std) FROM ({_numeric_profile_sql('orders_gappy', ORDERS_GAPPY_NUM)})", "orders_gappy"))
def numeric_profile_merged(spark, sf):
    out = G.grown_numeric_profile(spark, two_parts(spark, sf))
    return out.withColumns({"variance": F.round("variance", 0), "std": F.round("std", 3)})


@register("column_profile_merged", with_fixture(_colprof_sql("orders_gappy", ORDERS_GAPPY_COLS), "orders_gappy"))
def column_profile_merged(spark, sf):
    return G.grown_column_profile(spark, two_parts(spark, sf))


@register("histogram_merged", with_fixture(_hist_sql("orders_gappy", ["o_custkey", "price_n"]), "orders_gappy"))
def histogram_merged(spark, sf):
    return G.grown_histogram(spark, two_parts(spark, sf), ["o_custkey", "price_n"])


@register("top_values_merged", with_fixture(_top_sql("orders_gappy", ["priority_n"]), "orders_gappy"))
def top_values_merged(spark, sf):
    return G.grown_top_values(spark, two_parts(spark, sf))
