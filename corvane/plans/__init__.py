"""All queries over the driver's tables, with their SQL twins."""

from corvane.plans import architecture, code, core, more, retrieval, steps
from corvane.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "architecture", "code", "core", "more", "retrieval", "steps"]
