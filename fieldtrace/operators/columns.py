"""Whole-frame column operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim_blanks


def quoted(name: str) -> str:
    """Column reference for a name that may hold dots or blanks."""
    return "`" + name.replace("`", "``") + "`"


def resolve_column(df: DataFrame, *, suffix: str | None = None,
                   prefix: str | None = None) -> str:
    """The one column whose name ends / starts as given, ignoring case."""
    def fits(name: str) -> bool:
        low = name.lower()
        return ((suffix is None or low.endswith(suffix.lower()))
                and (prefix is None or low.startswith(prefix.lower())))

    found = [c for c in df.columns if fits(c)]
    if len(found) != 1:
        raise ValueError(f"expected one column for suffix={suffix!r} prefix={prefix!r}, "
                         f"found {found}")
    return found[0]


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename ``old -> new``; a missing old name is an error."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(names))


def rename_matching(df: DataFrame, new: str, *, suffix: str | None = None,
                    prefix: str | None = None) -> DataFrame:
    return df.withColumnRenamed(resolve_column(df, suffix=suffix, prefix=prefix), new)


def cast_columns(df: DataFrame, cols: Sequence[str], to: str = "string") -> DataFrame:
    return df.withColumns({c: F.col(quoted(c)).cast(to) for c in cols})


def null_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Add typed null placeholders."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})


def order_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Put the named columns first and keep the rest in place."""
    rest = [c for c in df.columns if c not in first]
    return df.select(*[quoted(c) for c in (*first, *rest)])


def trim_all(df: DataFrame) -> DataFrame:
    """Strip blanks and tabs from every string column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: trim_blanks(F.col(quoted(c))) for c in texts})
