"""All named queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from evidentia.plans import history_queries, issue_queries, metric_queries, mining_queries, normal_queries, operation_queries, read_queries, relational_queries, state_queries, stream_queries
from evidentia.plans.registry import ORACLES, QUERIES

MODULES = (metric_queries, relational_queries, mining_queries, issue_queries, state_queries, normal_queries, read_queries, stream_queries, history_queries, operation_queries)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
