"""The cube's queries: each applies one operator to the driver's tables."""

from tidecube.queries import aggregates, joins, models, scalars, scoring, sources, splits, weekly  # noqa: F401
from tidecube.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
