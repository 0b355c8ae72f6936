"""All registered queries."""

from taxatally.plans import count_queries, mixed_queries, read_queries, search_queries, stat_queries  # noqa: F401
from taxatally.plans.registry import CATALOGUE

__all__ = ["CATALOGUE"]
