"""Registered queries of the engine's own operators, with their SQL."""

from . import more  # noqa: F401  (registers its queries)
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
