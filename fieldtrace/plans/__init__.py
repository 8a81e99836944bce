"""Composed plans."""

from .accounting import RowCounts
from .event_table import REPAIRS, ROW_ORDER, event_table, report

__all__ = ["REPAIRS", "ROW_ORDER", "RowCounts", "event_table", "report"]
