"""All registered queries of the core."""

from __future__ import annotations

from chronoweave.plans import graph_queries, journal_queries, problems, run_queries, score_queries, text_queries

MODULES = (problems, graph_queries, journal_queries, score_queries, text_queries, run_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
