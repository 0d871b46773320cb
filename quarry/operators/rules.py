"""Deterministic rules over the profile tables.

The expensive part is the profile (distributed); the rules read the per-column
profile table, which has one row per column, and produce small tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC
from .profile import column_profile, dataset_overview

# Alert and advice texts, as shown to users of the reference.
MSG_HIGH_CARDINALITY = "High cardinality detected ({n} unique values). May increase model complexity."
MSG_ID_LIKE = "ID-like column detected (100% unique). Likely unsuitable for prediction."
MSG_NEAR_UNIQUE = "Near-unique feature (>95% unique). Low generalization value."
ADVICE_DROP_HIGH_MISSING = "Drop Column (High Missing)"
ADVICE_IMPUTE_NUMERIC = "Impute with Median/Mean"
ADVICE_IMPUTE_OTHER = "Impute with Mode or Unknown"
ADVICE_CONSTANT = "Drop Column (Constant)"
ADVICE_ID_LIKE = "Drop Column (ID-like)"


def profile_alerts(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """high_cardinality (text, > 50 distinct), id_like (distinct = rows, not double), near_unique (> 95 %)."""
    prof = profile if profile is not None else column_profile(df)
    n = df.count()
    u = F.col("unique_count")
    not_double = F.col("dtype") != "double"
    high = F.when((F.col("dtype") == "string") & (u > 50), F.struct(
        F.lit("high_cardinality").alias("type"),
        F.replace(F.lit(MSG_HIGH_CARDINALITY), F.lit("{n}"), u.cast("string")).alias("message")))
    idl = F.when((u == n) & not_double, F.struct(F.lit("id_like").alias("type"), F.lit(MSG_ID_LIKE).alias("message")))
    near = F.when(~((u == n) & not_double) & (u / F.lit(float(max(n, 1))) > 0.95) & not_double,
                  F.struct(F.lit("near_unique").alias("type"), F.lit(MSG_NEAR_UNIQUE).alias("message")))
    out = prof.select("col_name", F.explode(F.array_compact(F.array(high, idl, near))).alias("a"))
    return out.select(F.col("a.type").alias("type"), "col_name", F.col("a.message").alias("message"))


def column_advice(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Per column: missing % (1 decimal), distinct count and a cleaning suggestion."""
    prof = profile if profile is not None else column_profile(df)
    n = df.count()
    missing = F.col("missing_count")  # counts: a rounded share would hide a few missing values among many rows
    numeric = F.col("col_class") == NUMERIC
    sugg = (F.when(missing > 0, F.when(2 * missing > n, ADVICE_DROP_HIGH_MISSING).when(numeric, ADVICE_IMPUTE_NUMERIC)
                   .otherwise(ADVICE_IMPUTE_OTHER))
            .when(F.col("unique_count") == 1, ADVICE_CONSTANT)
            .when((F.col("unique_count") == n) & ~numeric, ADVICE_ID_LIKE)
            .otherwise(""))
    return prof.select("col_name", F.round("missing_pct", 1).alias("missing_pct"), "unique_count", sugg.alias("suggestion"))


@dataclass(frozen=True)
class StepRule:
    """One suggestion: the columns that ask for it, when the table does, and what it says."""

    step: str
    title: str
    impact: Callable[[Row], str]
    columns: Column | None = None  # over the profile; None: the whole table
    holds: Callable[[Row], bool] = lambda ov: True  # over the overview
    least: int = 1  # columns


def _step_rules(rows: int) -> list[StepRule]:
    missing, numeric = F.col("missing_count") > 0, F.col("col_class") == NUMERIC
    share = lambda ov: ov["total_missing_cells"] / max(ov["rows"] * ov["columns"], 1)
    level = lambda name: lambda ov: name
    return [
        StepRule("fillna_median", "Fill gaps with the column median", level("medium"), missing & numeric),
        StepRule("fillna_mean", "Fill gaps with the column mean", level("medium"), missing & numeric),
        StepRule("fillna_mode", "Fill gaps with the most frequent value", level("medium"), missing & ~numeric),
        StepRule("dropna_rows", "Drop rows with gaps", lambda ov: "high" if share(ov) > 0.15 else "medium", missing, lambda ov: 0 < share(ov) < 0.3),
        StepRule("drop_columns", "Drop columns that are mostly gaps", level("high"), 2 * F.col("missing_count") > rows),
        StepRule("drop_duplicates_all", "Drop repeated rows", level("medium"), None, lambda ov: ov["duplicate_rows"] > 0),
        StepRule("label_encoder", "Encode categories as numbers", level("high"), ~numeric),
        StepRule("standard_scaler", "Bring numbers to one scale", level("medium"), numeric, least=2),
    ]


def _indexed(df: DataFrame, profile: DataFrame) -> DataFrame:
    """The profile with each column's position, so that ties have one order."""
    return profile.withColumn("_at", F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("col_name")))


def data_insights(df: DataFrame, profile: DataFrame | None = None, overview: DataFrame | None = None) -> DataFrame:
    """Short sentences on shape, gaps, repeated rows, column kinds and constant columns."""
    prof = _indexed(df, profile if profile is not None else column_profile(df))
    ov = (overview if overview is not None else dataset_overview(df)).first()
    gaps, numeric, constant = F.col("missing_count") > 0, F.col("col_class") == NUMERIC, F.col("unique_count") == 1
    one = prof.agg(
        F.count_if(gaps).alias("gappy"), F.count_if(numeric).alias("numeric"), F.count_if(~numeric).alias("other"), F.count_if(constant).alias("constants"),
        F.max_by("col_name", F.struct("missing_count", -F.col("_at"))).alias("worst"), F.max("missing_count").alias("most"),
        F.min_by("col_name", F.when(constant, F.col("_at"))).alias("constant"))
    rows, repeated = max(ov["rows"], 1), ov["duplicate_rows"]
    said = [
        (F.lit(True), F.format_string("%d rows in %d columns", F.lit(ov["rows"]), F.lit(ov["columns"]))),
        (F.col("gappy") > 0, F.format_string("%d columns have gaps, most of all %s (%.4f%%)", "gappy", "worst", F.col("most") * 100.0 / rows)),
        (F.col("gappy") == 0, F.lit("No column has gaps")),
        (F.lit(repeated > 0), F.format_string("%d rows repeat another (%.4f%%)", F.lit(repeated), F.lit(repeated * 100.0 / rows))),
        (F.lit(repeated == 0), F.lit("No row repeats another")),
        (F.lit(True), F.format_string("%d numeric and %d other columns", "numeric", "other")),
        (F.col("constants") > 0, F.format_string("%d columns hold a single value, the first is %s", "constants", "constant")),
    ]
    texts = F.array_compact(F.array(*[F.when(holds, text) for holds, text in said]))
    return one.select(F.posexplode(texts).alias("idx", "insight")).select((F.col("idx") + 1).alias("idx"), "insight")


def suggest_steps(df: DataFrame, profile: DataFrame | None = None, overview: DataFrame | None = None) -> DataFrame:
    """Rule-based suggestions, each naming a runnable step and all columns it concerns."""
    prof = _indexed(df, profile if profile is not None else column_profile(df))
    ov = (overview if overview is not None else dataset_overview(df)).first()
    rules = [r for r in _step_rules(ov["rows"]) if r.holds(ov)]
    found = [F.array_sort(F.collect_list(F.when(r.columns, F.struct("_at", "col_name")))) if r.columns is not None
             else F.lit(None).cast("array<struct<_at:int,col_name:string>>") for r in rules]
    picked = prof.agg(F.array(*[f.cast("array<struct<at:int,col_name:string>>") for f in found]).alias("f"))
    rows = []
    for i, r in enumerate(rules):
        names = F.col("f")[i]["col_name"]
        whole = r.columns is None
        rows.append(F.struct(
            F.lit(r.step).alias("id"), F.lit(r.title).alias("title"),
            (F.lit("the whole table") if whole else F.format_string("%d columns", F.size(names))).alias("description"),
            (F.lit("all") if whole else F.array_join(names, ",")).alias("affected_columns"),
            F.lit(r.impact(ov)).alias("impact"), F.lit(r.step).alias("step"),
            (F.lit(True) if whole else F.size(names) >= r.least).alias("holds")))
    if not rows:
        return df.sparkSession.createDataFrame([], "idx int, id string, title string, description string, affected_columns string, impact string, step string")
    kept = picked.select(F.posexplode(F.filter(F.array(*rows), lambda x: x["holds"])).alias("idx", "r"))
    return kept.select((F.col("idx") + 1).alias("idx"), "r.*").drop("holds")


def available_step_groups(df: DataFrame, overview: DataFrame | None = None) -> DataFrame:
    """Which step groups apply to this table."""
    ov = (overview if overview is not None else dataset_overview(df)).first()
    groups = []
    if ov["total_missing_cells"] > 0:
        groups.append("missing_values")
    if ov["duplicate_rows"] > 0:
        groups.append("duplicates")
    if ov["numeric_count"] > 0:
        groups += ["outliers", "scaling", "distribution"]
    if ov["columns"] - ov["numeric_count"] > 0:
        groups.append("encoding")
    return df.sparkSession.createDataFrame([(g,) for g in groups], "step_group string")
