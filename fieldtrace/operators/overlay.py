"""Lay patches over base rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalesce_patch(base: Column, *patches: Column) -> Column:
    """The first non-null patch value, strongest first, else the base value."""
    return F.coalesce(*patches, base)


def _one_patch(patch: DataFrame, on: Sequence[str], cols: Sequence[str],
               drop_flag: str | None, prefer: Sequence[str]) -> DataFrame:
    """``(__key, __patch)``: one entry per key; a repeat is resolved or stops the job."""
    gone = [] if drop_flag is None else [F.col(drop_flag).alias("__gone")]
    entry = F.struct(*[F.col(c) for c in cols], *gone)
    key = F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(on)])
    rows = patch.select(key.alias("__key"), F.struct(*prefer).alias("__rank") if prefer
                        else F.lit(0).alias("__rank"), entry.alias("__patch"))
    if prefer:
        # Patches that tie in all of these are told apart by what they say.
        best = F.max(F.struct("__rank", "__patch"))["__patch"]
        return rows.groupBy("__key").agg(best.alias("__patch"))
    once = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.first("__patch").alias("__patch"))
    stop = F.raise_error(F.concat(F.lit("repeated patch key "), F.col("__key").cast("string")))
    return once.select("__key", F.when(F.col("__n") > 1, stop.cast(once.schema["__patch"].dataType))
                       .otherwise(F.col("__patch")).alias("__patch"))


def overlay(base: DataFrame, patch: DataFrame, on: Sequence[str], cols: Sequence[str],
            drop_flag: str | None = None, prefer: Sequence[str] = ()) -> DataFrame:
    """Patch ``cols`` of the base rows that have a partner on ``on``.

    Keys match null to null.  Base rows whose partner carries ``drop_flag`` are
    removed; a null patch value leaves the base value.  A key that the patch repeats
    stops the job, unless ``prefer`` names columns of the patch: then the row with
    the greatest of them counts, as a whole, and base rows never multiply.

    The patch is reduced to one row per key in the shuffle that the join needs
    anyway.  Only the base may repeat a key, and adaptive execution splits that side
    of the left join where it is skewed.
    """
    # Structs are equal where their fields are, nulls included.
    own = F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(on)])
    found = _one_patch(patch, on, cols, drop_flag, list(prefer))
    joined = base.withColumn("__key", own).join(found, "__key", "left")
    if drop_flag is not None:
        joined = joined.where(F.col("__patch.__gone").isNull())
    return joined.select(*[
        coalesce_patch(F.col(f"`{c}`"), F.col(f"__patch.`{c}`")).alias(c) if c in cols
        else F.col(f"`{c}`") for c in base.columns])
