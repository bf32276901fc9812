"""The training-data queries by name. SQL is given where DuckDB can express the query."""

from __future__ import annotations

from functools import wraps


def _modules() -> list:
    from strandgraph.llm import chat, contamination, embeddings, filters, lexical, mixing, multiset, packing, privacy, quality, simhash, substrings, toxicity

    return [embeddings, privacy, multiset, chat, simhash, substrings, toxicity, quality, packing, mixing, contamination, lexical, filters]


def _as_application(query):
    from strandgraph.llm.common import small_batches

    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _as_application(f) for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in getattr(m, "ORACLE_SQL", {}).items()}
