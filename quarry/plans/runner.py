"""Ordered step runs with dynamic column selection and a run log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, q, resolve_columns
from .fitted import STEP_FITTERS, STEP_REQUESTS, Fitted, Request, solve
from .guards import cut_lineage, spread

LOG_SCHEMA = ("step int, name string, status string, message string, columns string, "
              "skipped string, description string")

# One-line step descriptions for the run log.
DESCRIPTIONS = {
    "fillna_mean": "Fill missing values with the column mean",
    "fillna_median": "Fill missing values with the column median",
    "fillna_mode": "Fill missing values with the most frequent value",
    "fillna_ffill": "Fill missing values with the previous value",
    "fillna_bfill": "Fill missing values with the next value",
    "dropna_rows": "Drop rows with missing values",
    "drop_duplicates_all": "Drop duplicate rows",
    "drop_duplicates_subset": "Drop rows duplicated on the selected columns",
    "drop_columns": "Drop the selected columns",
    "derive": "Add a column from an expression",
    "standard_scaler": "Standardise to mean 0 and standard deviation 1",
    "minmax_scaler": "Scale to the range 0 to 1",
    "robust_scaler": "Scale by median and interquartile range",
    "maxabs_scaler": "Scale by the maximum absolute value",
    "unit_vector_scaler": "Scale each row to unit length",
    "log_transform": "Log transform",
    "sqrt_transform": "Square root transform",
    "boxcox_transform": "Box-Cox power transform",
    "yeojohnson_transform": "Yeo-Johnson power transform",
    "quantile_transform": "Quantile transform",
    "reciprocal_transform": "Reciprocal transform",
    "label_encoder": "Label encoding",
    "onehot_encoder": "One-hot encoding",
    "ordinal_encoder": "Ordinal encoding",
    "remove_outliers_iqr": "Remove outliers outside the IQR fences",
    "remove_outliers_zscore": "Remove outliers by z-score",
    "clip_outliers": "Clip values to quantiles",
    "winsorize_outliers": "Winsorize both tails",
}


@dataclass(frozen=True)
class Step:
    """One step: ``op`` name, column selector (``mode`` all/include/exclude over ``columns``), params."""

    op: str
    columns: tuple = ()
    params: dict = field(default_factory=dict)
    mode: str = "include"
    target: str | None = None


def _load_steps():
    from ..operators import distribution, encode, impute, outliers, rows, scale  # noqa: F401


def _step(st) -> Step:
    if isinstance(st, dict):
        return Step(st.get("op") or st.get("transformation_type"), tuple(st.get("columns", ())),
                    dict(st.get("params", {})), st.get("mode", "include"), st.get("target"))
    return st


class _Run:
    """Steps over a table, fitted in as few jobs as their dependencies allow.

    *Waiting* steps have said what they ask (``Request``) and touch different columns, so all their
    requests are answered over the same rows, in one job, when a step comes that needs their result.
    Fits that follow each other read a *view*: the columns that the coming requests need, written once
    (if more than one scan is due), to which each fitted step is applied as well.  The table itself is
    written only after a step that shuffles rows (deduplication, ordered fills, joins of dictionaries),
    and only if another fit has to read it."""

    def __init__(self, df: DataFrame, steps: list[Step]):
        self.table, self.steps = df, steps
        self.waiting: list[tuple[int, list[str], Request]] = []
        self.view: DataFrame | None = None
        self.shuffled = False
        self.log: list[tuple] = []

    def note(self, i: int, status: str, message: str, columns, skipped=()) -> None:
        op = self.steps[i].op
        self.log.append((i + 1, op, status, message, ",".join(columns), ",".join(skipped), DESCRIPTIONS.get(op, str(op))))

    def columns(self, i: int) -> list[str]:
        st = self.steps[i]
        return resolve_columns(self.table.columns, st.mode, st.columns, st.target)

    def settle(self) -> None:
        if self.shuffled:
            self.table, self.shuffled = cut_lineage(self.table), False

    def ahead(self, start: int) -> tuple[list[str], int]:
        """The columns that requests from step ``start`` on read, and the scans they need, up to a step that changes rows."""
        read, touched, scans, grouped = [], set(), 0, False
        for k in range(start, len(self.steps)):
            op = self.steps[k].op
            if op in STEP_REQUESTS:
                cols = numeric_columns(self.table, self.columns(k))
                request = STEP_REQUESTS[op](self.table, cols, **self.steps[k].params)
                if touched & set(cols) or not grouped:
                    scans, touched, grouped = scans + 1, set(), True
                scans += 2 * bool(request.quantiles)
                touched |= set(cols)
                read += [c for c in cols if c not in read]
            elif op not in IN_PLACE:
                break
        return read, scans

    def rows_for(self, columns: list[str], start: int) -> DataFrame:
        if self.view is None or not set(columns) <= set(self.view.columns):
            self.settle()
            read, scans = self.ahead(start)
            self.view = self.table.select(*[q(c) for c in self.table.columns if c in {*read, *columns}])
            if scans > 1:
                self.view = cut_lineage(spread(self.view))
        return self.view

    def apply(self, fitted: Fitted) -> None:
        self.table = fitted.apply(self.table)
        if self.view is not None:
            self.view = fitted.apply(self.view)

    def flush(self) -> bool:
        """Fit and apply the waiting steps; False if one failed (it and what follows are not applied)."""
        waiting, self.waiting = self.waiting, []
        if not waiting:
            return True
        requests = [r for _, _, r in waiting]
        try:
            rows = self.rows_for([c for r in requests for c in r.columns], waiting[0][0])
            answers = [solve(rows, requests)]
        except Exception:  # noqa: BLE001 - which step failed shows when each is fitted by itself
            answers = None
        for k, (i, cols, request) in enumerate(waiting):
            try:
                fitted = answers[0][k] if answers else solve(self.table, [request])[0]
                self.apply(fitted)
            except Exception as e:  # noqa: BLE001 - recorded in the log
                self.note(i, "failed", f"Error: {e}", cols)
                return False
            self.note(i, "success", "Transformation applied successfully", fitted.columns, fitted.skipped)
        return True

    def take(self, i: int) -> bool:
        """One step; False if it, or one that waited for it, failed."""
        st, request = self.steps[i], None
        cols = self.columns(i)
        touched = {c for _, _, r in self.waiting for c in r.columns}
        try:
            if st.op in STEP_REQUESTS and not touched & set(cols):
                request = STEP_REQUESTS[st.op](self.table, cols, **st.params)
        except Exception:  # noqa: BLE001 - raised again below, after the waiting steps
            pass
        if request is not None:
            self.waiting.append((i, cols, request))
            return True
        if not self.flush():
            return False
        cols = self.columns(i)
        try:
            if st.op not in STEP_FITTERS:
                raise KeyError(f"unknown step {st.op!r}")
            if st.op in STEP_REQUESTS:
                self.waiting.append((i, cols, STEP_REQUESTS[st.op](self.table, cols, **st.params)))
                return True
            if st.op not in NO_FIT:
                self.settle()
            fitted = STEP_FITTERS[st.op](self.table, cols, **st.params)
            if st.op in IN_PLACE:
                self.table = fitted.apply(self.table)
                if self.view is not None and set(fitted.columns) & set(self.view.columns):
                    self.view = None
            else:
                self.table, self.view = fitted.apply(self.table), None
                self.shuffled = self.shuffled or not fitted.stateless
        except Exception as e:  # noqa: BLE001 - recorded in the log
            self.note(i, "failed", f"Error: {e}", cols)
            return False
        self.note(i, "success", "Transformation applied successfully", fitted.columns, fitted.skipped)
        return True


#: Steps that only project: rows and other columns stay as they are.
IN_PLACE = {"derive", "drop_columns"}
#: Steps that read nothing before they are applied.
NO_FIT = {*IN_PLACE, "dropna_rows", "drop_duplicates_all", "drop_duplicates_subset"}


def run_pipeline(df: DataFrame, steps, atomic: bool = False):
    """Fold the steps over ``df``; stop at the first failure.

    Returns ``(result, log)``.  Without ``atomic`` the steps before the failure are
    kept (batch behaviour); with ``atomic`` a failure returns the input unchanged.
    Unknown step names fail (they are not silently ignored).  Independent fits share
    a job and fits in a row read a narrow written copy (``_Run``)."""
    _load_steps()
    run = _Run(df, [_step(st) for st in steps])
    done = all(run.take(i) for i in range(len(run.steps))) and run.flush()
    result = df if (atomic and not done) else run.table
    return result, df.sparkSession.createDataFrame(run.log, LOG_SCHEMA)


def run_summary(original: DataFrame, result: DataFrame, log: DataFrame) -> DataFrame:
    """One row: totals of the run log and the original and final shape."""
    return log.agg(
        F.count("*").alias("total_steps"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.lit(original.count()).alias("original_rows"), F.lit(len(original.columns)).alias("original_columns"),
        F.lit(result.count()).alias("final_rows"), F.lit(len(result.columns)).alias("final_columns"))


def run_previews(original: DataFrame, result: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows before and after, as (side, position, values): values by column name, as text."""
    out = None
    for side, df in (("before", original), ("after", result)):
        top = df.orderBy(*[q(c) for c in order_by]).limit(n)
        w = Window.orderBy(*[q(c) for c in order_by])  # n rows
        cells = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[q(c).cast("string") for c in df.columns]))
        one = top.select(F.lit(side).alias("side"), F.row_number().over(w).alias("position"), cells.alias("cells"))
        one = one.select("side", "position", F.explode("cells").alias("col_name", "value"))
        out = one if out is None else out.unionByName(one)
    return out
