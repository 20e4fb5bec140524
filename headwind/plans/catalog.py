"""Importing this module registers every query."""

from headwind.plans import catalog_articles, catalog_clusters, catalog_flows, catalog_market  # noqa: F401
from headwind.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
