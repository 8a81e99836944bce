"""Look-behind classification, row multiplication and ordered union.

Multiplied rows carry small rank columns (0 for the copy, 1 for the original)
and piece positions, so that the final order is an ordinary sort key instead of
a side effect of how frames were stacked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import matches, when_chain
from ..functions.text import (attach_text, count_pattern, remove_all,
                              replace_first, trim_blanks)
from ..vocabulary import (ANY_SIZE, APPROACH, COMPETITION, DIG_END, DIG_PREFIX,
                          FEW_ENDING, FEW_NAME, FOUND_PREFIX, LARGER_SIZES,
                          LOOSE_MARKER, MANY_ENDING, MANY_NAME, MIRRORED, MUTUAL,
                          NAMED_SIZES, OTHER_PREFIX, OUTCOMES, OWN_PREFIX, RECEIVED,
                          RECEIVED_ITEM, SCAN_MARKER, TINY, TINY_FEW, TINY_MANY)
from .timeline import Behind, Timeline


NEAR_DEPTH = 3
NEAR_COLUMNS = tuple(f"__back_{k}" for k in range(1, NEAR_DEPTH + 1))


def near_looks(label: Column, where: Column | None = None) -> dict[str, Behind]:
    return {"__back": Behind(label, where, NEAR_DEPTH)}


def is_near(skip: str = SCAN_MARKER, target: str = DIG_END) -> Column:
    near, between = F.lit(False), F.lit(True)
    for col in NEAR_COLUMNS:
        near = near | (between & matches(col, target))
        between = between & matches(col, skip)
    return near


def near_marker(df: DataFrame, timeline: Timeline, label: Column, *,
                where: Column | None = None, skip: str = SCAN_MARKER,
                target: str = DIG_END, name: str = "near") -> DataFrame:
    """Is there a ``target`` row at most three rows back, with only ``skip`` rows
    between?  Rows are those where ``where`` holds, by default all."""
    return (timeline.look(df, **near_looks(label, where))
            .withColumn(name, is_near(skip, target)).drop(*NEAR_COLUMNS))


def is_loose(label: str) -> Column:
    return F.coalesce(F.col(label) == LOOSE_MARKER, F.lit(False))


def is_sized_loose(label: str = "behavior", modifiers: str = "modifiers") -> Column:
    return is_loose(label) & matches(modifiers, ANY_SIZE)


def duplicate_where(df: DataFrame, pred: Column, rank: str,
                    updates: Mapping[str, Column] | None = None) -> DataFrame:
    """Repeat the rows where ``pred`` holds; ``updates`` apply to the copy.

    ``rank`` is 0 on copies and 1 on originals, so copies sort first.
    """
    ranks = F.when(pred, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    out = df.withColumn(rank, F.explode(ranks))
    copy = F.col(rank) == 0
    return out.withColumns({c: F.when(copy, v).otherwise(F.col(c))
                            for c, v in (updates or {}).items()})


def explode_tokens(df: DataFrame, col: str | Column, sep: str, into: str, pos: str) -> DataFrame:
    """One row per token; a null list keeps its row with a null token."""
    text = F.col(col) if isinstance(col, str) else col
    return (df.select("*", F.posexplode_outer(F.split(text, sep)).alias("__pos", "__token"))
            .withColumns({pos: F.coalesce("__pos", F.lit(0)), into: F.col("__token")})
            .drop("__pos", "__token"))


def as_lists(df: DataFrame, cols: Sequence[str], sep: str) -> DataFrame:
    """Replace each text by the list of its pieces, ``__l_<name>``.

    A null text is a list of one null.  Lists must be of equal length or of
    length one; where they are not, ``__uneven`` holds and each list is the
    whole text.
    """
    lists = {f"__l_{c}": F.coalesce(F.split(F.col(c), sep),
                                    F.array(F.lit(None).cast("string"))) for c in cols}
    df = df.withColumns(lists)
    longest = F.greatest(*[F.size(p) for p in lists])
    uneven = reduce(or_, [(F.size(p) != 1) & (F.size(p) != longest) for p in lists])
    df = df.withColumn("__uneven", uneven)
    return df.withColumns({f"__l_{c}": F.when(F.col("__uneven"), F.array(F.col(c)))
                           .otherwise(F.col(f"__l_{c}")) for c in cols}).drop(*cols)


def judge_uneven(df: DataFrame, on_mismatch: str = "raise", check: str = "check") -> DataFrame:
    """Stop the job at rows with uneven lists, or with ``'flag'`` mark them."""
    if on_mismatch not in ("raise", "flag"):
        raise ValueError(f"on_mismatch must be 'raise' or 'flag', not {on_mismatch!r}")
    if on_mismatch == "flag":
        return df.withColumn(check, F.when(F.col("__uneven"), F.lit(True)).otherwise(
            F.col(check))).drop("__uneven")
    stop = F.raise_error(F.lit("lists of different length in one row"))
    first = next(c for c in df.columns if c.startswith("__l_"))
    return df.withColumn(first, F.when(F.col("__uneven"), stop.cast("array<string>"))
                         .otherwise(F.col(first))).drop("__uneven")


def places(lists: Sequence[str]) -> Column:
    """One row per place of the longest list, numbered from 0."""
    longest = F.greatest(*[F.size(p) for p in lists])
    return F.explode(F.sequence(F.lit(0), longest - 1))


def piece(pieces: Column, place: Column) -> Column:
    """The piece at a place; a list of one serves every place."""
    return F.when(F.size(pieces) == 1, pieces[0]).otherwise(pieces[place])


def zip_explode(df: DataFrame, cols: Sequence[str], sep: str, pos: str = "piece_pos",
                on_mismatch: str = "raise", check: str = "check") -> DataFrame:
    """Split several lists in parallel, one row per place (see :func:`as_lists`)."""
    lists = [f"__l_{c}" for c in cols]
    split = judge_uneven(as_lists(df, cols, sep), on_mismatch, check)
    split = split.withColumn(pos, places(lists))
    return split.withColumns({c: piece(F.col(f"__l_{c}"), F.col(pos)) for c in cols}).drop(*lists)


def two_small(modifiers: str = "modifiers") -> Column:
    """A list that names only tiny items, more than one."""
    return (matches(modifiers, TINY) & ~matches(modifiers, LARGER_SIZES)
            & F.coalesce(count_pattern(modifiers, ";") > 1, F.lit(False)))


def residual_text(modifiers: str = "modifiers") -> Column:
    """Letters left after the size words are taken out."""
    return matches(remove_all(modifiers, ANY_SIZE), "[a-zA-Z]")


def explode_sizes(df: DataFrame, several: Column, *, label: str = "behavior",
                  modifiers: str = "modifiers", found: Column | None = None) -> DataFrame:
    """One row per size named in the cell, where ``several`` holds.

    ``found`` marks rows whose labels take the ``fa.`` prefix instead of ``d.``.
    Adds ``size_rank`` (0 on exploded rows) and ``size_pos``.
    """
    m = F.col(modifiers)
    tests = [*[(n, n) for n in NAMED_SIZES], (TINY_FEW, FEW_NAME), (TINY_MANY, MANY_NAME)]
    endings = {**NAMED_SIZES, FEW_NAME: FEW_ENDING, MANY_NAME: MANY_ENDING}
    hit = F.coalesce(several, F.lit(False))
    # No size at all gives one empty token.
    sizes = F.split(F.concat_ws(";", *[F.when(matches(modifiers, t), F.lit(n))
                                       for t, n in tests]), ";")
    tokens = F.when(hit, sizes).otherwise(F.array(F.lit(None).cast("string")))
    rows = (df.withColumns({"__hit": hit,
                            "__found": F.lit(False) if found is None
                            else F.coalesce(found, F.lit(False))})
            .select("*", F.posexplode(tokens).alias("size_pos", "__size")))
    size = F.col("__size")
    prefix = F.when(F.col("__found"), F.lit(FOUND_PREFIX)).otherwise(F.lit(DIG_PREFIX))
    named = when_chain([(size == n, F.concat(prefix, F.lit(e))) for n, e in endings.items()],
                       F.col(label))
    return (rows.withColumns({
        label: named, modifiers: F.when(F.col("__hit"), size).otherwise(m),
        "size_rank": F.when(F.col("__hit"), 0).otherwise(1)})
        .drop("__hit", "__found", "__size"))


def outcome_of(tag: Column, before: Column) -> Column:
    """A competition outcome, prefixed with the competition tag before it."""
    return F.when(tag.isin(*OUTCOMES) & matches(before, COMPETITION),
                  attach_text(before, tag)).otherwise(tag)


def attach_outcome(df: DataFrame, timeline: Timeline, col: str = "agg_sub") -> DataFrame:
    """Prefix a competition outcome with the competition tag on the row before."""
    return (timeline.look(df, __before=Behind(F.col(col)))
            .withColumn(col, outcome_of(F.col(col), F.col("__before"))).drop("__before"))


def explode_conditional(df: DataFrame, pred: Column, sep: str, col: str = "behavior",
                        pos: str = "approach_pos") -> DataFrame:
    """Split ``col`` into rows only where ``pred`` holds."""
    return (explode_tokens(df, F.when(pred, F.col(col)), sep, "__part", pos)
            .withColumn(col, F.coalesce("__part", F.col(col))).drop("__part"))


def splits_approach(col: str = "behavior") -> Column:
    return matches(col, APPROACH) & matches(col, ";")


def mirror_partner(df: DataFrame, *, keep_partner: bool = False, literal: bool = False,
                   label: str = "behavior", partner: str = "partner",
                   tags: str = "ob") -> DataFrame:
    """Split initiate-and-receive rows into the own and the mirrored view.

    The copy's partner entry reads ``Receive`` and its label flips from ``i.``
    to ``r.``; the original loses the ``Receive;`` item.  As written, the flip
    tests any character after ``i``, labels without the prefix become null on
    the copy, and the partner becomes null on every row that is not split;
    ``literal`` and ``keep_partner`` mend that.
    """
    p = F.col(partner)
    both = (matches(partner, RECEIVED) & ~matches(label, APPROACH)
            & F.coalesce(F.col(tags) == "", F.lit(False)) & matches(partner, "|".join(MUTUAL)))
    df = df.withColumn("__both", both)
    other = p if keep_partner else F.lit(None).cast("string")
    df = df.withColumn(partner, F.when(F.col("__both"), replace_first(p, RECEIVED_ITEM, ""))
                       .otherwise(other))
    mirrored = F.col(partner)
    for word in MUTUAL:
        mirrored = replace_first(mirrored, word, MIRRORED)
    own = trim_blanks(label)
    if literal:
        flipped = F.when(own.startswith(OWN_PREFIX), F.concat(
            F.lit(OTHER_PREFIX), F.substr(own, F.lit(len(OWN_PREFIX) + 1)))).otherwise(own)
    else:
        prefix = "^" + OWN_PREFIX
        flipped = F.when(own.rlike(prefix), F.regexp_replace(own, prefix, OTHER_PREFIX))
    return duplicate_where(df, F.col("__both"), "mirror_rank",
                           {partner: trim_blanks(mirrored), label: flipped}).drop("__both")


def union_ordered(copies: DataFrame, originals: DataFrame, rank: str) -> DataFrame:
    """Stack copies before originals; ``rank`` keeps that order as data."""
    return (copies.withColumn(rank, F.lit(0))
            .unionByName(originals.withColumn(rank, F.lit(1)), allowMissingColumns=True))
