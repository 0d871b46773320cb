"""Column classes, selectors and the ingest-time NULL rule."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
OTHER = "other"

# Fixed selector tokens accepted by every step (values shared with the reference's requests).
ALL_COLUMNS = "__ALL_COLUMNS__"
ALL_EXCEPT_TARGET = "__ALL_EXCEPT_TARGET__"


def column_class(data_type: T.DataType) -> str:
    """numeric / categorical / datetime / other for a Spark type."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(data_type, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    return OTHER


def classes(df: DataFrame) -> dict[str, str]:
    return {f.name: column_class(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    wanted = df.columns if cols is None else [c for c in cols if c in df.columns]
    kinds = classes(df)
    return [c for c in wanted if kinds[c] == NUMERIC]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c, k in classes(df).items() if k == CATEGORICAL]


def datetime_columns(df: DataFrame) -> list[str]:
    return [c for c, k in classes(df).items() if k == DATETIME]


def is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def dtype_name(data_type: T.DataType) -> str:
    return data_type.simpleString()


def nan_to_null(df: DataFrame) -> DataFrame:
    """G1: NaN becomes NULL on float/double columns, once, at ingest."""
    fixes = {
        f.name: F.when(~F.isnan(q(f.name)), q(f.name))
        for f in df.schema.fields
        if is_float(f.dataType)
    }
    return df.withColumns(fixes) if fixes else df


def q(name: str) -> Column:
    """Column by exact name (dots and spaces allowed)."""
    return F.col(f"`{name.replace('`', '``')}`")


def resolve_columns(
    columns: Sequence[str],
    mode: str = "include",
    selected: Sequence[str] = (),
    target: str | None = None,
) -> list[str]:
    """Resolve a step's column selector against the *current* columns.

    ``all``: every column; ``include``: the selected ones that still exist, in
    selection order; ``exclude``: every current column not selected (columns
    created by earlier steps are therefore included).  The tokens
    ``__ALL_COLUMNS__`` / ``__ALL_EXCEPT_TARGET__`` expand in place.
    """
    current = list(columns)
    if mode == "all":
        return current
    chosen: list[str] = []
    for name in selected:
        if name == ALL_COLUMNS:
            chosen.extend(current)
        elif name == ALL_EXCEPT_TARGET:
            chosen.extend(c for c in current if c != target)
        else:
            chosen.append(name)
    if mode == "exclude":
        drop = set(chosen)
        return [c for c in current if c not in drop]
    seen: set[str] = set()
    out = []
    for c in chosen:
        if c in current and c not in seen:
            seen.add(c)
            out.append(c)
    return out


def free_name(base: str, *taken: Iterable[str]) -> str:
    """``base``, with underscores put before it until no name in ``taken`` equals it (names match in any case)."""
    used = {n.lower() for names in taken for n in names}
    while base.lower() in used:
        base = "_" + base
    return base


def free_names(taken: Iterable[str], *bases: str) -> list[str]:
    """A free name for each base, different from each other."""
    used, out = list(taken), []
    for base in bases:
        out.append(free_name(base, used))
        used.append(out[-1])
    return out


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named ``c0, c1, ...`` and the map from the old names, for work that needs names of its own."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))
