"""All named queries. Importing the plan modules fills the registry."""

from waymark.plans import build_plans, query_plans, relation_plans, route_plans, search_plans, stream_plans, text_plans, usage_plans  # noqa: F401
from waymark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
