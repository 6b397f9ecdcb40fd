"""Registry of named queries (Spark callable + optional DuckDB oracle text)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is its DuckDB oracle."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all():
    """Import every module that registers queries."""
    from tessera.plans import (  # noqa: F401
        search_queries,
        text_queries,
        chunk_queries,
        embed_queries,
        index_queries,
        stats_queries,
        stream_queries,
        ingest_queries,
        store_queries,
    )

    return QUERIES, ORACLES
