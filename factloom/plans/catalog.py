"""All queries of the knowledge operators."""

from __future__ import annotations

from factloom.plans import asks, crawl, entities, governance, graphs, mentions, packs, readiness, relational, reports, retrieval, texts, trails, upkeep, weave  # noqa: F401
from factloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
