"""Registered queries: each runs an operator over whole tables, next to the
SQL that states the same result independently."""

from . import columns, intervals, rows, session, table
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "columns", "intervals", "rows", "session", "table"]
