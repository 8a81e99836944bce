"""Column-level functions: plain Spark expressions, no Python UDF."""

from .clock import (clean_date, clock_to_seconds, date_text, format_clock,
                    fraction_to_seconds, normalize_time)
from .logic import (as_column, keyword_label, matches, na_ifelse, review_flag,
                    when_chain)
from .text import (attach_text, compose_id, count_pattern, extract_bracketed,
                   merge_tags, normalize_direction, remove_all, replace_first,
                   replace_map, size_label, trim_blanks)

__all__ = [
    "as_column", "attach_text", "clean_date", "clock_to_seconds",
    "compose_id", "count_pattern", "date_text", "extract_bracketed",
    "format_clock", "fraction_to_seconds", "keyword_label", "matches",
    "merge_tags", "na_ifelse", "normalize_direction", "normalize_time",
    "remove_all", "replace_first", "replace_map", "review_flag", "size_label",
    "trim_blanks", "when_chain",
]
