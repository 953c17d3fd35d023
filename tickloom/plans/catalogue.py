"""Every registered query of the reference's operators with its SQL oracle."""

from __future__ import annotations

from . import queries_aggregate, queries_domain, queries_joins, queries_research, queries_series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (queries_joins, queries_aggregate, queries_series, queries_domain, queries_research):
    QUERIES |= module.BOOK.queries
    ORACLES |= module.BOOK.oracles
