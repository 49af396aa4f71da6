"""Registered queries of the analytics operators and their DuckDB statements."""

from . import core_queries, finance_queries, indicator_queries, sim_queries, store_queries  # noqa: F401

QUERIES: dict = dict(core_queries.QUERIES)
ORACLES: dict[str, str] = dict(core_queries.ORACLES)
