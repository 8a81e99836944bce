"""Text functions over one or several columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import (DIRECTED, DIRECTION_MAP, FEW_ENDING, INITIATED, LEADING_RECEIVE,
                          LIST_MARK, MANY_ENDING, NAMED_SIZES, SPREAD_MARK, TINY,
                          TINY_ENDING, TINY_FEW, TINY_MANY)
from .logic import as_column, matches, when_chain


def count_pattern(col: Column | str, pattern: str) -> Column:
    """Number of matches; null text gives null."""
    return F.regexp_count(as_column(col), F.lit(pattern))


def replace_first(col: Column | str, pattern: str, replacement: str) -> Column:
    """Replace only the first match (``regexp_replace`` replaces all)."""
    return F.regexp_replace(as_column(col), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def remove_all(col: Column | str, pattern: str) -> Column:
    return F.regexp_replace(as_column(col), pattern, "")


def replace_map(col: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace literal keys by their values; keys must not overlap."""
    out = as_column(col)
    for old, new in mapping.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def trim_blanks(col: Column | str) -> Column:
    """Strip blanks and tabs at both ends."""
    return F.btrim(as_column(col), F.lit(" \t"))


def extract_bracketed(col: Column | str) -> Column:
    """All text inside innermost round brackets, joined; ``''`` if there is none."""
    return F.array_join(
        F.regexp_extract_all(as_column(col), F.lit(r"\(([^()]*)\)"), F.lit(1)), "")


def compose_id(cols: Sequence[Column | str], sep: str = ".", na_text: str = "NA") -> Column:
    """Join parts into one id; a missing part is written as ``na_text``."""
    return F.concat_ws(
        sep, *[F.coalesce(as_column(c).cast("string"), F.lit(na_text)) for c in cols])


def merge_tags(cols: Sequence[Column | str], sep: str = "; ") -> Column:
    """Join the non-null parts; ``''`` when all are null."""
    return F.concat_ws(sep, *[as_column(c) for c in cols])


def attach_text(first: Column | str, second: Column | str, sep: str = " ") -> Column:
    """Concatenate two texts; null if either is null."""
    return F.concat(as_column(first), F.lit(sep), as_column(second))


def normalize_direction(col: Column | str, guard: Column | str | None = None) -> Column:
    """Write ``Initiate; x`` as ``Initiate x`` (same for ``Receive``) and spread
    a leading ``Receive`` over a longer list unless ``guard`` says ``Initiate``.

    ``guard`` is the text tested for ``Initiate``; by default the column itself.
    """
    raw = as_column(col)
    directed = matches(col, DIRECTED)
    joined = F.when(directed, replace_map(raw, DIRECTION_MAP)).otherwise(raw)
    single = directed & F.coalesce(count_pattern(raw, ";") == 1, F.lit(False))
    guarded = matches(col if guard is None else guard, INITIATED)
    spread = matches(col, LEADING_RECEIVE) & ~single & ~guarded
    return F.when(spread, F.replace(joined, F.lit(LIST_MARK), F.lit(SPREAD_MARK))).otherwise(joined)


def size_label(modifiers: Column | str, prefix: str, *, lone_tiny: bool) -> Column:
    """Label for a cell that names one size; null when it names none or several.

    ``lone_tiny`` also labels a bare ``Tiny``.
    """
    m = as_column(modifiers)
    cases = [(matches(modifiers, name), F.lit(prefix + ending))
             for name, ending in NAMED_SIZES.items()]
    cases.append((matches(modifiers, TINY_FEW), F.lit(prefix + FEW_ENDING)))
    cases.append((m == TINY_MANY, F.lit(prefix + MANY_ENDING)))
    if lone_tiny:
        cases.append((m == TINY, F.lit(prefix + TINY_ENDING)))
    return F.when(count_pattern(m, ";") <= 1, when_chain(cases))
