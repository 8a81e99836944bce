"""State intervals: pair start and end markers inside one family of rows.

Each family sees only its own rows.  A row's look-ahead is the next row *of the
family*; from it come end time, duration, inherited modifiers and comments, and
the removal of end markers.  The result is one nullable struct per family, null
on rows the family does not touch, so several families are merged by coalescing
field by field.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import matches, when_chain
from ..functions.text import count_pattern, size_label
from ..vocabulary import (DIG_STOPS, ACCEPTED_DIG_ENDS, ANY_SIZE, DEFAULT_OUTCOME, DIG,
                          DIG_END, DIG_PREFIX, LOOSE_MARKER, REDIG_END,
                          REMOVABLE_DIG_ENDS, SCAN_MARKER)
from .timeline import Ahead, Behind, Look, Timeline

@dataclass(frozen=True)
class Fields:
    """Which columns hold what; None for a field the log does not have."""
    label: str = "behavior"
    time: str = "st_sec"
    modifiers: str | None = "modifiers"
    comments: str | None = "comments"
    check: str | None = "check"

    def text(self, name: str | None) -> Column:
        return F.lit(None).cast("string") if name is None else F.col(name)

    def flag(self) -> Column:
        return F.lit(None).cast("boolean") if self.check is None else F.col(self.check)

    def row(self, label: Column | None = None) -> Column:
        """What a look-ahead brings back: a label (or a test of it) and the rest."""
        return F.struct(F.col(self.label).alias("b") if label is None else label,
                        F.col(self.time).alias("t"), self.text(self.modifiers).alias("m"),
                        self.text(self.comments).alias("c"), self.flag().alias("k"))


@dataclass(frozen=True)
class FamilySpec:
    """How one family of state rows is paired.

    members   ``match``: rows that match ``start``; ``run``: those whose
              previous raw row matches too; ``touch``: matching rows and any
              labelled row right after one (which can end a state, but is not
              itself changed).
    unpaired  end of a start whose next member is no end marker: ``none``,
              ``point`` (one second later) or ``next`` (the next member).
    end_pairs  an end marker followed by another one is paired like a start.
    flag_unpaired  such starts get the review flag.
    reset_check    the family ignores an earlier review flag.
    """
    name: str
    start: str
    end: str
    exclude: str | None = None
    members: str = "match"
    unpaired: str = "none"
    end_pairs: bool = False
    flag_unpaired: bool = False
    reset_check: bool = False

    @property
    def needs_previous(self) -> bool:
        return self.members != "match"

    def flag(self, kind: str) -> str:
        return f"__{self.name}_{kind}"

    def flags(self, fields: Fields, previous: Column | None = None) -> dict[str, Column]:
        """Label tests, as columns, so that they are evaluated once per row:
        rows the family changes, end markers, and rows that only end a state."""
        label = fields.label
        hit, allowed = matches(label, self.start), F.lit(True)
        if self.exclude is not None:
            allowed = ~matches(label, self.exclude)
        out = {self.flag("own"): hit & allowed, self.flag("end"): matches(label, self.end)}
        if self.members == "run":
            out[self.flag("own")] = hit & allowed & matches(previous, self.start)
        elif self.members == "touch":
            out[self.flag("after")] = (matches(previous, self.start) & allowed
                                       & F.col(label).isNotNull())
        return out

    def looks(self, fields: Fields) -> dict[str, Look]:
        own = F.col(self.flag("own"))
        row = fields.row(F.col(self.flag("end")).alias("e"))
        if self.members != "touch":
            return {self.flag("next"): Ahead(row, own)}
        return {self.flag("next"): Ahead(row, own | F.col(self.flag("after"))),
                self.flag("note"): Ahead(row, own)}

    def patch(self, fields: Fields) -> dict[str, Column]:
        """New values, each null on rows the family does not change."""
        time, is_end = F.col(fields.time), F.col(self.flag("end"))
        nxt = F.col(self.flag("next"))
        note = F.col(self.flag("note")) if self.members == "touch" else nxt
        followed = F.coalesce(nxt["e"], F.lit(False))
        paired = followed if self.end_pairs else followed & ~is_end
        alone = ~followed & ~is_end
        cases = [(paired, nxt["t"])]
        if self.unpaired == "point":
            cases.append((alone, time + 1))
        elif self.unpaired == "next":
            cases.append((alone, nxt["t"]))
        end_sec = when_chain(cases)
        kept = F.lit(None).cast("boolean") if self.reset_check else fields.flag()
        check = F.when(alone, F.lit(True)).otherwise(kept) if self.flag_unpaired else kept
        gone_next = F.coalesce(note["e"], F.lit(False))
        if not self.reset_check:
            gone_next = gone_next & note["k"].isNull()
        values = {
            "end_sec": end_sec, "duration": end_sec - time,
            "modifiers": inherit_modifiers(paired, nxt["m"], fields.text(fields.modifiers)),
            "comments": inherit_comments(gone_next, note["c"], fields.text(fields.comments)),
            "check": check, "removed": mark_end_markers(is_end, kept)}
        return {k: F.when(F.col(self.flag("own")), v) for k, v in values.items()}


# --- fixed values: the five marker families ----------------------------------
FAMILIES = {
    "ga": FamilySpec("ga", "GA", "GA; End", unpaired="point", end_pairs=True),
    "gt": FamilySpec("gt", "GT", "GT; End", exclude="GT other", members="run",
                     unpaired="next", end_pairs=True),
    "burr": FamilySpec("burr", "Burr/BH renn", "Burr/BH renn; End", members="touch",
                       unpaired="next"),
    "inburr": FamilySpec("inburr", "In burr/BH", "In burr/BH; End", flag_unpaired=True),
    "oov": FamilySpec("oov", "Out of view", "Out of view; End", flag_unpaired=True,
                      reset_check=True),
}


def inherit_modifiers(paired: Column, following: Column, own: Column) -> Column:
    """A paired row takes its partner's modifiers (null if the partner has none)."""
    return F.when(paired, following).otherwise(own)


def inherit_comments(gone: Column, following: Column, own: Column) -> Column:
    """A row takes the comment of a removed row right after it; undecided (null)
    when that row stays but has a comment."""
    return F.when(following.isNull(), own).when(gone, following)


def mark_end_markers(is_end: Column, check: Column) -> Column:
    """Flag end markers for removal unless they are under review."""
    return F.when(check.isNull() & is_end, F.lit(True))


def as_patch(values: dict[str, Column], own: Column) -> Column:
    """One nullable struct of a family's values."""
    return F.when(own, F.struct(*[v.alias(k) for k, v in values.items()]))


def state_intervals(df: DataFrame, timeline: Timeline, specs: Sequence[FamilySpec],
                    fields: Fields = Fields()) -> DataFrame:
    """Add one patch struct per family, named after it."""
    before, temp = None, []
    if any(s.needs_previous for s in specs):
        df = timeline.settle(timeline.look(df, __previous=Behind(F.col(fields.label))))
        before, temp = F.col("__previous"), ["__previous"]
    flags: dict[str, Column] = {}
    looks: dict[str, Look] = {}
    for spec in specs:
        flags |= spec.flags(fields, before)
        looks |= spec.looks(fields)
    found = timeline.look(df.withColumns(flags), **looks)
    return (found.withColumns({s.name: as_patch(s.patch(fields), F.col(s.flag("own")))
                               for s in specs})
            .drop(*flags, *looks, *temp))


# --- digs --------------------------------------------------------------------

def is_scan_only(label: Column) -> Column:
    """Pure scan rows: a scan marker and nothing after a semicolon."""
    return F.coalesce(matches(label, SCAN_MARKER) & (count_pattern(label, ";") == 0),
                      F.lit(False))


def other_looks(fields: Fields) -> dict[str, Look]:
    return {"__kept_next": Ahead(F.struct(F.col(fields.label).alias("b"),
                                          F.col(fields.time).alias("t")),
                                 ~is_scan_only(F.col(fields.label)))}


# The look-ahead of a dig that is taken as written, and the one that only dig
# rows and loose markers can stop.
STOPS_AS_WRITTEN = DIG_STOPS
STOPS_DIG_ONLY = r"Dig|^End \(\+Modifiers\)"


def dig_flags(fields: Fields, stops: str = STOPS_AS_WRITTEN) -> dict[str, Column]:
    """``__other``: digs whose next row, scan rows aside, is no dig or end.
    ``__dig``: every other dig row, dig end and loose marker."""
    label = F.col(fields.label)
    dig, loose = matches(fields.label, DIG), F.coalesce(label == LOOSE_MARKER, F.lit(False))
    other = (dig & ~is_scan_only(label) & ~matches(fields.label, "End")
             & ~matches("__kept_next.b", stops))
    return {"__other": other, "__dig": ~other & (dig | loose)}


def other_patch(fields: Fields) -> dict[str, Column]:
    nxt = F.col("__kept_next")
    values = {
        "end_sec": nxt["t"], "duration": nxt["t"] - F.col(fields.time),
        "modifiers": fields.text(fields.modifiers), "comments": fields.text(fields.comments),
        "check": fields.flag(), "removed": F.lit(None).cast("boolean")}
    return {k: F.when(F.col("__other"), v) for k, v in values.items()}


def ended_by_other(df: DataFrame, timeline: Timeline, fields: Fields = Fields(),
                   stops: str = STOPS_AS_WRITTEN) -> DataFrame:
    """Add the patch ``by_other`` of digs that another row ends."""
    found = timeline.look(df, **other_looks(fields)).withColumns(dig_flags(fields, stops))
    return (found.withColumn("by_other", as_patch(other_patch(fields), F.col("__other")))
            .drop("__kept_next", "__other", "__dig"))


def dig_looks(fields: Fields) -> dict[str, Look]:
    return {"__dig_next": Ahead(fields.row(), F.col("__dig"), depth=2)}


def followed_by_end(label: Column | str, next_label: Column | str) -> Column:
    """Is the next dig row an end of this one?  A plain dig end also counts as
    followed by a re-dig end, whose label contains it."""
    return (~matches(label, DIG_END) & matches(next_label, DIG_END)) | (
        ~matches(label, REDIG_END) & matches(next_label, REDIG_END))


def dig_outcome(df: DataFrame, fields: Fields, own_size: bool = False) -> DataFrame:
    """Add what each dig row becomes, in steps, since later ones reuse earlier."""
    label, modifiers = fields.label, fields.text(fields.modifiers)
    df = df.withColumns({
        "__dig_end": matches(label, DIG_END),
        "__loose": F.coalesce(F.col(label) == LOOSE_MARKER, F.lit(False)),
        "__followed": followed_by_end(label, "__dig_next_1.b")})
    followed, loose = F.col("__followed"), F.col("__loose")
    # The second case is only reached when the end names no size.
    cases = [(followed & matches("__dig_next_1.m", ANY_SIZE), F.col("__dig_next_1.m")),
             (followed & ~loose, F.lit(DEFAULT_OUTCOME))]
    if own_size:
        cases.insert(0, (loose & matches(modifiers, ANY_SIZE), modifiers))
    df = df.withColumn("__dig_mods", when_chain(cases, modifiers))
    return df.withColumn("__size", F.when(
        F.col("__dig_end"), size_label("__dig_mods", DIG_PREFIX, lone_tiny=True)))


def odd_dig_end(label: str) -> Column:
    """A dig end in none of the accepted spellings."""
    return matches(label, DIG_END) & ~F.col(label).isin(*ACCEPTED_DIG_ENDS)


def several_sizes(is_end: Column, modifiers: Column) -> Column:
    return F.when(is_end & (count_pattern(modifiers, ";") > 1), F.lit(True))


def unsized_dig_end(label: str, modifiers: Column | str, check: Column, next_label: str,
                    next_modifiers: str) -> Column:
    """Is it a dig end that is left without a size and not under review?"""
    sized = F.when(followed_by_end(label, next_label), matches(next_modifiers, ANY_SIZE)) \
        .otherwise(matches(modifiers, ANY_SIZE))
    removable = F.coalesce(F.col(label).isin(*REMOVABLE_DIG_ENDS), F.lit(False))
    return check.isNull() & removable & ~sized


DIG_STEPS = ("__dig_end", "__loose", "__followed", "__dig_mods", "__size")


def dig_patch(fields: Fields) -> dict[str, Column]:
    """The family's values, read from the columns of :func:`dig_outcome`."""
    nxt, time, check = F.col("__dig_next_1"), F.col(fields.time), fields.flag()
    modifiers = fields.modifiers or F.lit(None).cast("string")
    followed, loose, is_end = F.col("__followed"), F.col("__loose"), F.col("__dig_end")
    end_sec = when_chain([(~followed & ~is_end & ~loose, time + 1),
                          (followed & ~loose, nxt["t"])])
    gone = unsized_dig_end(fields.label, modifiers, check, "__dig_next_1.b", "__dig_next_1.m")
    gone_next = unsized_dig_end("__dig_next_1.b", "__dig_next_1.m", nxt["k"],
                                "__dig_next_2.b", "__dig_next_2.m")
    values = {
        "end_sec": end_sec, "duration": end_sec - time, "modifiers": F.col("__dig_mods"),
        "comments": inherit_comments(gone_next, nxt["c"], fields.text(fields.comments)),
        "check": F.when(F.col("__size").isNull() & odd_dig_end(fields.label), F.lit(True))
        .otherwise(check),
        "removed": F.when(gone, F.lit(True)),
        "label": F.coalesce("__size", fields.label),
        "several": several_sizes(is_end, F.col("__dig_mods"))}
    return {k: F.when(F.col("__dig"), v) for k, v in values.items()}


def dig_intervals(df: DataFrame, timeline: Timeline, fields: Fields = Fields(), *,
                  stops: str = STOPS_AS_WRITTEN, own_size: bool = False) -> DataFrame:
    """Add the patch ``dig``: digs, dig ends and loose markers that no other
    row ends.  It also has the new label and whether an end names several sizes."""
    found = timeline.look(df, **other_looks(fields)).withColumns(dig_flags(fields, stops))
    found = dig_outcome(timeline.look(timeline.settle(found), **dig_looks(fields)),
                        fields, own_size)
    return (found.withColumn("dig", as_patch(dig_patch(fields), F.col("__dig")))
            .drop("__kept_next", "__other", "__dig", "__dig_next_1", "__dig_next_2",
                  *DIG_STEPS))
