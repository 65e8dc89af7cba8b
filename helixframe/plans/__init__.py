"""Registered queries over the shared tables."""

from . import analytics, core, curation, fixtures, further, more, reporting
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics", "core", "curation", "fixtures", "further", "more", "reporting"]
