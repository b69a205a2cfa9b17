"""Imports every query module, which fills the registry."""

from . import fact_queries, graph_queries, ingest_queries, listing_queries, resolve_queries, run_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query, Tables  # noqa: F401
