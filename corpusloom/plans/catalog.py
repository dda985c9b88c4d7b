"""All queries of the library's own operators."""

from __future__ import annotations

from corpusloom.plans import agreement_queries, corpus_queries, error_queries, flow_queries, generation_queries, graph_queries, morphology_queries, score_queries, source_queries, text_queries

MODULES = (text_queries, corpus_queries, score_queries, source_queries, error_queries, generation_queries, flow_queries, agreement_queries, morphology_queries, graph_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
