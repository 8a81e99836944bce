"""Reading and writing session logs."""

from .sessions import (DICTIONARY_SCHEMA, LOG_SCHEMA, check_positions, from_headings,
                       listed_in_bulk, name_sessions, read_dictionary, read_log, read_sessions,
                       write_grouped, write_log, write_sessions, write_table)

__all__ = ["DICTIONARY_SCHEMA", "LOG_SCHEMA", "check_positions", "from_headings",
           "listed_in_bulk", "name_sessions", "read_dictionary", "read_log", "read_sessions",
           "write_grouped", "write_log", "write_sessions", "write_table"]
