"""All named queries over the star-schema tables, each with its SQL oracle."""

from oreline.plans import append_queries, aggregate_queries, geo_queries, line_queries, model_queries, temporal_queries  # noqa: F401  they register themselves
from oreline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
