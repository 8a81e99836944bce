"""Tidy event tables from raw, timestamped session logs, on Spark."""

from . import functions, operators, plans, sources, vocabulary
from .plans import REPAIRS, event_table, report
from .sources import (read_dictionary, read_log, read_sessions, write_log, write_sessions,
                      write_table)

__all__ = ["REPAIRS", "event_table", "functions", "operators", "plans",
           "read_dictionary", "read_log", "read_sessions", "report", "sources", "vocabulary",
           "write_log", "write_sessions", "write_table"]
