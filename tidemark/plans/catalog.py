"""Registered queries."""

from __future__ import annotations

from tidemark.plans import agent_queries, bar_queries, dataset_queries, event_queries, evidence_queries, indicator_queries, learner_queries, metric_queries, model_queries, panel_queries, record_queries, scoring_queries, selection_queries, structure_queries
from tidemark.plans.bar_queries import flagship
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["flagship", "queries", "oracle_sql"]
MODULES = (bar_queries, indicator_queries, structure_queries, metric_queries, event_queries, panel_queries, model_queries, scoring_queries, record_queries, evidence_queries, agent_queries, learner_queries, selection_queries, dataset_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
