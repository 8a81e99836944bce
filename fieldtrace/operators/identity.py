"""Session identity and running state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import as_column
from .timeline import Latest, Running, Timeline


def fill_down(df: DataFrame, timeline: Timeline, cols: Sequence[str]) -> DataFrame:
    """Replace nulls by the last earlier value; ``''`` counts as a value."""
    filled = timeline.look(df, **{f"fill_{c}": Latest(F.col(c)) for c in cols})
    return (filled.withColumns({c: F.col(f"fill_{c}") for c in cols})
            .drop(*[f"fill_{c}" for c in cols]))


def running_counter(df: DataFrame, timeline: Timeline, starts: Column,
                    name: str = "counter") -> DataFrame:
    """Count the rows so far where ``starts`` holds; 0 before the first."""
    hit = F.coalesce(as_column(starts).cast("int"), F.lit(0))
    return timeline.look(df, **{name: Running(hit)})


def row_position(df: DataFrame, timeline: Timeline, name: str = "row_no") -> DataFrame:
    """Dense 1-based place of each row in the timeline's order."""
    return timeline.look(df, **{name: Running(F.lit(1))})
