"""DataFrame operators over session timelines."""

from .columns import (cast_columns, null_columns, order_columns, rename_columns,
                      rename_matching, resolve_column, trim_all)
from .identity import fill_down, row_position, running_counter
from .intervals import (FAMILIES, FamilySpec, dig_intervals, ended_by_other,
                        inherit_comments, inherit_modifiers, mark_end_markers,
                        state_intervals)
from .lookup import relabel
from .overlay import coalesce_patch, overlay
from .rows import (attach_outcome, duplicate_where, explode_conditional,
                   explode_sizes, explode_tokens, mirror_partner, near_marker,
                   union_ordered, zip_explode)
from .timeline import (Ahead, Behind, Latest, Running, Timeline, long_sessions,
                       per_session, row_sequence)

__all__ = [
    "Ahead", "Behind", "FAMILIES", "FamilySpec", "Latest", "Running",
    "Timeline", "attach_outcome", "cast_columns", "coalesce_patch",
    "dig_intervals", "duplicate_where", "ended_by_other",
    "explode_conditional", "explode_sizes", "explode_tokens", "fill_down",
    "inherit_comments", "inherit_modifiers", "long_sessions",
    "mark_end_markers", "mirror_partner", "near_marker", "null_columns",
    "order_columns", "overlay", "per_session", "relabel", "rename_columns",
    "rename_matching", "resolve_column", "row_position", "row_sequence",
    "running_counter", "state_intervals", "trim_all", "union_ordered",
    "zip_explode",
]
