"""Fit / apply split shared by every transform step.

``fit`` runs at most a few bounded aggregate jobs and keeps the result as
literals (or, for large dictionaries, as a small DataFrame); ``apply`` only
extends the logical plan, so consecutive steps collapse into one Project and
stateless ones also run on a streaming DataFrame.

Steps whose fit is made of aggregates and quantiles say so in a ``Request``
(``planned``): requests of independent steps are then answered together, in one
aggregate and one quantile search over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from .guards import fused_agg
from .quantiles import column_quantiles

STEP_FITTERS: dict[str, Callable[..., Fitted]] = {}


@dataclass
class Fitted:
    name: str
    columns: list[str]
    apply_fn: Callable[[DataFrame], DataFrame]
    skipped: list[str] = field(default_factory=list)
    stateless: bool = True  # True: apply is a pure projection/filter, usable on a stream
    values: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.apply_fn(df)


def step(name: str):
    """Register ``fit(df, cols, **params) -> Fitted`` under a step name."""

    def deco(fn):
        STEP_FITTERS[name] = fn
        return fn

    return deco


@dataclass
class Request:
    """What a step asks of the table and how the answers make the step.

    It reads and writes ``columns`` only (in place, no row added or dropped): ``aggs`` are aggregates by a
    name of the step's own, ``quantiles`` the probabilities by column; ``build`` gets both answers."""

    columns: list[str]
    build: Callable[[dict, dict], Fitted]
    aggs: dict[str, Column] = field(default_factory=dict)
    quantiles: dict[str, list[float]] = field(default_factory=dict)
    method: str = "exact"


STEP_REQUESTS: dict[str, Callable[..., Request]] = {}


def planned(name: str):
    """Register ``request(df, cols, **params) -> Request`` under a step name; returns its fitter."""

    def deco(fn):
        def fit(df: DataFrame, cols, *args, **params) -> Fitted:
            return solve(df, [fn(df, cols, *args, **params)])[0]

        fit.__doc__, fit.__name__ = fn.__doc__, fn.__name__
        STEP_REQUESTS[name] = fn
        STEP_FITTERS[name] = fit
        return fit

    return deco


def solve(df: DataFrame, requests: list[Request]) -> list[Fitted]:
    """Answer all requests over the rows of ``df``: one aggregate job (per 40 aggregates), one quantile search a method."""
    asked = {f"r{i}.{k}": x for i, r in enumerate(requests) for k, x in r.aggs.items()}
    values = fused_agg(df, [x.alias(k) for k, x in asked.items()]) if asked else {}
    probs: dict[str, dict[str, list[float]]] = {}
    for r in requests:
        for c, ps in r.quantiles.items():
            known = probs.setdefault(r.method, {}).setdefault(c, [])
            known.extend(p for p in ps if p not in known)
    found = {m: column_quantiles(df, list(of), of, method=m) for m, of in probs.items()}
    out = []
    for i, r in enumerate(requests):
        of = {c: [found[r.method][c][probs[r.method][c].index(p)] for p in ps] for c, ps in r.quantiles.items()}
        out.append(r.build({k: values[f"r{i}.{k}"] for k in r.aggs}, of))
    return out


def transform(name: str, df: DataFrame, cols, **params) -> DataFrame:
    """Fit and apply one step."""
    if name not in STEP_FITTERS:
        raise KeyError(f"unknown step: {name}")
    return STEP_FITTERS[name](df, list(cols or []), **params).apply(df)
