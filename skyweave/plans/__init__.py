"""Queries over the given tables, each with its SQL twin."""

from . import catalog_queries, feature_queries, series_queries
from .series_queries import most_variable

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (series_queries, feature_queries, catalog_queries):
    QUERIES |= _module.REGISTRY.queries
    ORACLES |= _module.REGISTRY.oracles

__all__ = ["ORACLES", "QUERIES", "most_variable"]
