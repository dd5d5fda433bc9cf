"""Registered queries by operator id, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from . import compliance_queries, corpus_queries, evaluation_queries
from .registered import Registered

FLAGSHIP = "c03_verify_bids"
ALL = Registered(compliance_queries.OWN, evaluation_queries.OWN, corpus_queries.OWN)
QUERIES, ORACLE_SQL = ALL.queries, ALL.oracle_sql
