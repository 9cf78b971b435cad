"""Every registered query over the given tables with its SQL."""

from __future__ import annotations

from . import queries_files, queries_labels, queries_records, queries_text
from .registry import ORACLE, QUERIES

FLAGSHIP = "retrieve_all"
__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "queries_files", "queries_labels", "queries_records", "queries_text"]
