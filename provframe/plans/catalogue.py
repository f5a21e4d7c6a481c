"""All registered queries: importing the plan modules fills the registry."""

from provframe.plans import algebra, derived, predicates, tpch, workloads  # noqa: F401
from provframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
