"""Queries over the test tables, by name, and their SQL."""

from promolens.queries import basics, effects, exploration, selection, streams  # noqa: F401
from promolens.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
