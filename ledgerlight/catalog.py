"""All registered queries with their equivalents in SQL."""

from .plans import audit, claims, detection, evidence, lifecycle, memory, retrieval, structure  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
