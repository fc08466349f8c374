"""All registered queries."""

from siftbook.plans import aggregates, increments, joins, projections, scans, selection  # noqa: F401
from siftbook.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
