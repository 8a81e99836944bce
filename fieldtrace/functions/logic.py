"""Conditions with explicit null rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"\^?[^\\.\[\](){}*+?^$]+")
_NAME = re.compile(r"\w+(\.\w+)*")
_STEM = re.compile(r"([^\\.\[\](){}*+?^$]+)\.")


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def matches(col: Column | str, pattern: str) -> Column:
    """Regex test in which a null text does not match (never null).

    Alternatives that are plain words become substring or prefix tests, which
    are much cheaper per row than a regex; words that end in a wildcard are
    tested for their stem first.
    """
    words = pattern.split("|")
    plain = all(_PLAIN.fullmatch(w) for w in words)
    if plain and isinstance(col, str) and _NAME.fullmatch(col):
        # The same test as below, as one expression text: plans ask this often.
        return F.expr(f"coalesce({' or '.join(_word_sql(col, w) for w in words)}, false)")
    text = as_column(col)
    if plain:
        test = _any_word(text, words)
    elif all(_STEM.fullmatch(w) for w in words):
        test = _any_word(text, [w[:-1] for w in words]) & text.rlike(pattern)
    else:
        test = text.rlike(pattern)
    return F.coalesce(test, F.lit(False))


def _word_sql(col: str, word: str) -> str:
    test = "startswith" if word[0] == "^" else "contains"
    quoted = word.removeprefix("^").replace("'", "\\'")
    path = ".".join(f"`{part}`" for part in col.split("."))
    return f"{test}({path}, '{quoted}')"


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [text.startswith(w[1:]) if w[0] == "^" else text.contains(w)
                        for w in words])


def na_ifelse(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice in which a null condition gives null, not ``no``."""
    return F.when(cond, yes).when(~cond, no)


def when_chain(cases: Sequence[tuple[Column, Column]],
               default: Column | None = None) -> Column:
    """Ordered multi-way choice; a null condition counts as no match."""
    (cond, value), *rest = cases
    chain = F.when(cond, value)
    for cond, value in rest:
        chain = chain.when(cond, value)
    return chain if default is None else chain.otherwise(default)


def keyword_label(col: Column | str, words: Sequence[str], sep: str = "; ") -> Column:
    """Name the words that occur in the text, in the given order; null if none."""
    found = F.concat_ws(sep, *[F.when(matches(col, w), F.lit(w)) for w in words])
    return F.nullif(found, F.lit(""))


def review_flag(filled: Column | str, check: Column | str) -> Column:
    """Raise the review flag where a field is filled, else keep it."""
    return F.when(as_column(filled).isNotNull(), F.lit(True)).otherwise(as_column(check))
