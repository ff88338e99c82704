"""Queries over the tables of a folder: plans built from the operators, and equivalent SQL."""

from tidemark.plans import aggregates, audits, contracts, details, estimates, histories, joins, lifecycle, models, portfolio, replays, scalars, texts
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "aggregates", "audits", "contracts", "details", "estimates", "histories", "joins", "lifecycle", "models", "portfolio", "replays", "scalars", "texts"]
