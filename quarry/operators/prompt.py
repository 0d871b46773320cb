"""Prompt rendering over rows: one prompt per row, built JVM-side."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """Literal text and ``{name}`` fields of a template (``{{`` / ``}}`` escape braces)."""
    if template is None:
        raise ValueError("No prompt template given")
    return [(lit, field) for lit, field, _spec, _conv in string.Formatter().parse(template)]


def render_prompt(df: DataFrame, template: str, out: str = "prompt") -> DataFrame:
    """Fill every ``{column}`` placeholder from the row; unknown names raise before any job runs."""
    parts = []
    for lit, field in template_parts(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            if field not in df.columns:
                raise KeyError(f"template field {field!r} is not a column")
            parts.append(F.coalesce(q(field).cast("string"), F.lit("None")))
    return df.withColumn(out, F.concat(*parts) if parts else F.lit(""))
