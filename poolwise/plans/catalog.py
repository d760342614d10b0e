"""All queries in one place."""

from poolwise.plans import queries_data, queries_effects, queries_fits, queries_results, queries_sets  # noqa: F401
from poolwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
