"""Helpers that spell oracle SQL for DuckDB (one SELECT per column, UNION ALL)."""

from __future__ import annotations


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def pct_sql(part: str, whole: str, digits: int = 2) -> str:
    return f"round(CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0) * 100.0, {digits})"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
