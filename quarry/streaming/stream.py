"""Fitted steps on Structured Streaming input.

Steps are fitted on a batch DataFrame; the ``apply`` half of a stateless step
(literal-only projections and row filters) is then valid on a streaming
DataFrame with the same schema.  Order-dependent or distinct-based steps are
refused; the streaming form of deduplication is ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.fitted import STEP_FITTERS, Fitted
from ..plans.runner import Step, _load_steps
from ..functions.columns import resolve_columns


def fit_steps(batch: DataFrame, steps: Sequence[Step]) -> list[Fitted]:
    """Fit each step on the batch (after the previous steps were applied)."""
    _load_steps()
    fitted, current = [], batch
    for st in steps:
        cols = resolve_columns(current.columns, st.mode, st.columns, st.target)
        f = STEP_FITTERS[st.op](current, cols, **st.params)
        fitted.append(f)
        current = f.apply(current)
    return fitted


def apply_to_stream(stream: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    """Apply fitted stateless steps to a streaming DataFrame."""
    out = stream
    for f in fitted:
        if not f.stateless:
            raise ValueError(f"step {f.name} needs the whole table and cannot run on a stream")
        out = f.apply(out)
    return out


def dedupe_stream(stream: DataFrame, cols: Sequence[str], event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Streaming duplicate removal on ``cols`` with state bounded by the event-time watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(cols))
