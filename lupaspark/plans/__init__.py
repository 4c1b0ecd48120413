"""Queries of the library over the given tables, and the SQL beside which each must come out the same."""

from lupaspark.plans import facts, jobs, mechanisms, money, offices, published  # noqa: F401  they register their queries
from lupaspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
