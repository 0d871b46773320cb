"""Registered queries of this package: ``opN_<name>`` over whole tables, and the pipeline."""

from __future__ import annotations

from . import q_corpus, q_pages, q_tables, q_text  # noqa: F401
from .common import ORACLE, QUERIES  # noqa: F401
