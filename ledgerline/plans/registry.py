"""All registered queries of the statement and retrieval families."""

from __future__ import annotations

from . import answer_queries, audit_queries, chain_queries, chunk_queries, planning_queries, rule_queries, sample_queries, statement_queries, text_queries  # noqa: F401

QUERIES = {**statement_queries.Q, **text_queries.Q, **chunk_queries.Q, **chain_queries.Q, **planning_queries.Q, **sample_queries.Q, **answer_queries.Q, **audit_queries.Q}
ORACLES = {**statement_queries.O, **text_queries.O, **chunk_queries.O, **chain_queries.O, **planning_queries.O, **sample_queries.O, **answer_queries.O, **audit_queries.O}
