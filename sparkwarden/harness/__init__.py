"""Registered queries over the driver's tables."""

from sparkwarden.harness import evaluation_queries, finding_queries, graph_queries, job_queries, search_queries, text_queries  # noqa: F401
from sparkwarden.harness.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
