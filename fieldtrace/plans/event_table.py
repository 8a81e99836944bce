"""From raw session logs to the tidy event table.

Every step is a DataFrame transformation over the session timeline.  For
ordinary sessions the whole plan has one shuffle (by session) besides the tiny
dictionary; sessions too long for a task are worked block by block.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import date_text, format_clock, normalize_time
from ..functions.logic import keyword_label, matches, review_flag
from ..functions.text import (compose_id, count_pattern, extract_bracketed,
                              merge_tags, normalize_direction, replace_map,
                              size_label, trim_blanks)
from ..operators.columns import order_columns, quoted, trim_all
from ..operators.intervals import (FAMILIES, STOPS_AS_WRITTEN, STOPS_DIG_ONLY,
                                   FamilySpec, Fields, dig_flags, dig_looks,
                                   dig_outcome, dig_patch, other_looks,
                                   other_patch)
from ..operators.lookup import fits_broadcast, relabel
from ..operators.overlay import coalesce_patch
from ..operators.rows import (NEAR_COLUMNS, as_lists, duplicate_where,
                              explode_conditional, explode_sizes,
                              explode_tokens, is_loose, is_near,
                              is_sized_loose, judge_uneven, mirror_partner,
                              near_looks, outcome_of, piece, places,
                              residual_text, splits_approach, two_small)
from ..operators.timeline import (BLOCK_ROWS, MEASURE, Behind, Latest,
                                  Running, Timeline, per_session)
from ..vocabulary import (CATEGORIES, DIG_PREFIX, FOUND_PREFIX, PLACES,
                          REPORT_HEADINGS, SECONDS_PER_DAY, SESSION_START,
                          WRESTLE_MAP)
from .accounting import RowCounts

# Opt-in corrections of the protocol's quirks; the default is as written.
REPAIRS = frozenset({
    "gt_first", "oov_check", "dig_lookahead", "near_original", "residual_text",
    "keep_flagged", "fa_multi", "own_guard", "dedup_original", "keep_partner",
    "mirror_literal", "fill_location", "rollover", "marker_own_size",
})

# Sort key of the finished rows inside a session: copies before originals.
ROW_ORDER = ("seq", "mirror_rank", "tag_rank", "size_rank", "marker_rank",
             "size_pos", "piece_pos", "tag_pos", "approach_pos")

# Strongest first; a label may belong to more than one family.
PRECEDENCE = ("dig", "oov", "burr", "gt", "inburr", "ga", "by_other")

# Merged field by field.  Durations follow from the merged end.
MERGED = ("end_sec", "modifiers", "comments")

_TAGS = ("agg_sub", "play", "olfactory")

# The columns of a log.
LOG_COLUMNS = frozenset({
    "session_id", "seq", "date", "time_raw", "time_2", "observer", "groups", "focal_individual",
    "behavior", "partner", *_TAGS, "pup_care", "modifiers", "sex", "life_history",
    "time_spent_running", "comments"})


def event_table(log: DataFrame, dictionary: DataFrame, *,
                repair: Collection[str] = (), on_mismatch: str = "raise",
                long: DataFrame | str | None = MEASURE,
                block_rows: int = BLOCK_ROWS, counts: RowCounts | None = None) -> DataFrame:
    """The tidy event table of all sessions.

    ``log`` has ``session_id``, ``seq`` (dense from 1) and the raw columns of
    the log schema; ``dictionary`` has ``behavior, replacement, dict_seq``.
    ``long`` lists sessions that need block-wise work (see ``per_session``).
    The struct ``row_order`` sorts rows inside a session; :func:`report` gives
    the final headings.  Further columns of ``log`` are kept, whatever their names,
    unless they are columns of the result.  A session that repeats a position stops the
    job that meets it.  Runs a job that measures the dictionary,
    and one that looks for long sessions unless ``long`` is given.  ``counts`` learns
    how many rows each step removed or added.
    """
    unknown = set(repair) - REPAIRS
    if unknown:
        raise ValueError(f"unknown repairs: {sorted(unknown)}")
    fixes = frozenset(repair)
    small = fits_broadcast(dictionary)
    extra = [c for c in log.columns if c not in LOG_COLUMNS]
    taken = sorted(set(extra) & {"row_order", *REPORT_HEADINGS})
    if taken:
        raise ValueError(f"the log has columns of the result: {taken}")
    if extra:
        # Out of reach of the columns that the passes add.
        log = log.select(*[c for c in log.columns if c in LOG_COLUMNS],
                         F.struct(*map(quoted, extra)).alias("__extra"))

    def work(rows: DataFrame, timeline: Timeline) -> DataFrame:
        rows = pack(list_tags(normalize(rows), fixes))
        rows = raw_pass(rows, timeline, fixes)
        rows = family_pass(timeline.settle(rows), timeline, fixes)
        rows = marker_pass(timeline.settle(rows), timeline, fixes, counts)
        rows = split_sizes(unpack(rows), fixes)
        rows = split_tags(judge_uneven(rows, on_mismatch))
        rows = tags_to_labels(rows, fixes)
        rows = relabel(rows, dictionary, small=small)
        rows = mirror_partner(rows, keep_partner="keep_partner" in fixes,
                              literal="mirror_literal" in fixes)
        if counts is not None:
            rows = counts.finished(rows, F.col("check"))
        return finalize(rows, fixes)

    done = per_session(log, work, long=long, block_rows=block_rows)
    return done.select("*", "__extra.*").drop("__extra") if extra else done


def normalize(df: DataFrame) -> DataFrame:
    """Time, tag types, ids as written in the row, place and review flag."""
    focal = F.col("focal_individual")
    return df.withColumns({
        **{c: F.col(c).cast("string") for c in _TAGS},
        "st_sec": normalize_time("time_raw"),
        "check": review_flag("pup_care", F.lit(None).cast("boolean")),
        "kmp_id": extract_bracketed(focal),
        "location": keyword_label("focal_individual", PLACES)}).drop("time_raw")


# Columns the look-up passes work on.
_ACTIVE = ("session_id", "seq", "st_sec", "behavior", "modifiers", "comments", "check",
           "kmp_id", "location", "date")


def pack(df: DataFrame) -> DataFrame:
    """Hold every other column in one struct while the look-ups run: sorting and
    windows then copy one value instead of a few dozen."""
    active = [c for c in df.columns if c in _ACTIVE]
    packed = [c for c in df.columns if c not in active]
    last_tag = F.element_at("__l_agg_sub", -1).alias("last_tag")
    return df.select(*active, last_tag, F.struct(*map(quoted, packed)).alias("packed"))


def unpack(df: DataFrame) -> DataFrame:
    return df.select("*", "packed.*").drop("packed")


def families(fixes: frozenset[str]) -> dict[str, FamilySpec]:
    specs = dict(FAMILIES)
    if "gt_first" in fixes:
        specs["gt"] = FamilySpec("gt", "GT", "GT; End", exclude="GT other",
                                 members="touch", unpaired="next", end_pairs=True)
    if "oov_check" in fixes:
        specs["oov"] = FamilySpec("oov", "Out of view", "Out of view; End",
                                  flag_unpaired=True)
    return specs


def raw_pass(df: DataFrame, timeline: Timeline, fixes: frozenset[str]) -> DataFrame:
    """Everything that looks at raw rows only: ids, previous label, the three
    families whose members are plain matches, and digs ended by another row.

    What these families say is kept in two groups, above and below the families
    of the next pass in :data:`PRECEDENCE`.
    """
    fields, specs, base = Fields(), families(fixes), df.columns
    early = [specs[n] for n in ("oov", "inburr", "ga")]
    looks = {"filled_id": Latest(F.col("kmp_id")),
             "focal_no": Running(matches("behavior", SESSION_START).cast("int")),
             "previous": Behind(F.col("behavior")), "__before": Behind(F.col("seq")),
             **other_looks(fields)}
    if "fill_location" in fixes:
        looks["filled_place"] = Latest(F.col("location"))
    flags: dict[str, Column] = {}
    for spec in early:
        flags |= spec.flags(fields)
        looks |= spec.looks(fields)
    df = timeline.look(df.withColumns(flags), **looks)
    stops = STOPS_DIG_ONLY if "dig_lookahead" in fixes else STOPS_AS_WRITTEN
    df = df.withColumns(dig_flags(fields, stops))
    patches = {s.name: s.patch(fields) for s in early} | {"by_other": other_patch(fields)}
    out = {"kmp_id": F.col("filled_id"),
           "focal_id": compose_id([F.month("date"), "focal_no", "filled_id"]),
           "__flagged": F.coalesce(*[p["check"] for p in patches.values()]),
           "__gone": stop_at_repeats(any_removed(patches))}
    if "fill_location" in fixes:
        out["location"] = F.col("filled_place")
    for field in MERGED:
        out[f"__oov_{field}"] = patches["oov"][field]
        out[f"__low_{field}"] = F.coalesce(
            *[patches[n][field] for n in PRECEDENCE if n in ("inburr", "ga", "by_other")])
    kept = [c for c in (*base, "previous", "__other", "__dig") if c not in out]
    return df.select(*kept, *timeline.extra(df, kept), *[v.alias(c) for c, v in out.items()])


def stop_at_repeats(value: Column) -> Column:
    """The value, or the end of the job where the row before has the same position.

    Read off the look-ups' own window.  It rests on a column that decides which rows
    stay, not on ``seq``, so that the order of the rows is still known.
    """
    stop = F.raise_error(F.concat(F.lit("session '"), F.col("session_id").cast("string"),
                                  F.lit("' repeats seq "), F.col("seq").cast("string")))
    return F.when(F.col("__before") == F.col("seq"), stop.cast("boolean")).otherwise(value)


def any_removed(patches: dict[str, dict[str, Column]]) -> Column:
    return reduce(or_, [p["removed"].isNotNull() for p in patches.values()])


def family_pass(df: DataFrame, timeline: Timeline, fixes: frozenset[str]) -> DataFrame:
    """The families that depend on the previous label or on the first pass, and
    the merge of all; rows that any family removes are marked ``gone``."""
    fields, specs, base = Fields(), families(fixes), df.columns
    late = [specs[n] for n in ("burr", "gt")]
    flags: dict[str, Column] = {}
    looks = dig_looks(fields)
    for spec in late:
        flags |= spec.flags(fields, F.col("previous"))
        looks |= spec.looks(fields)
    df = timeline.look(df.withColumns(flags), **looks)
    df = dig_outcome(df, fields, "marker_own_size" in fixes)
    patches = {s.name: s.patch(fields) for s in late} | {"dig": dig_patch(fields)}

    def merged(field: str, own: Column) -> Column:
        return coalesce_patch(own, patches["dig"][field], F.col(f"__oov_{field}"),
                              patches["burr"][field], patches["gt"][field],
                              F.col(f"__low_{field}"))

    out = {
        "behavior": coalesce_patch(F.col("behavior"), patches["dig"]["label"]),
        "several": F.coalesce(patches["dig"]["several"], F.lit(False)),
        "end_sec": merged("end_sec", F.lit(None).cast("bigint")),
        "modifiers": merged("modifiers", F.col("modifiers")),
        "comments": merged("comments", F.col("comments")),
        "check": F.coalesce(*[p["check"] for p in patches.values()],
                            F.col("__flagged"), F.col("check")),
        "gone": F.col("__gone") | any_removed(patches),
    }
    if "near_original" in fixes:
        out["written"] = F.col("behavior")
    kept = [c for c in base if c not in out and c != "previous" and not c.startswith("__")]
    return df.select(*kept, *timeline.extra(df, kept), *[v.alias(c) for c, v in out.items()])


def list_tags(df: DataFrame, fixes: frozenset[str]) -> DataFrame:
    """Normalise the tag texts and hold each as a list of trimmed pieces."""
    guard = None if "own_guard" in fixes else F.col("play")
    df = df.withColumns({"agg_sub": normalize_direction("agg_sub", guard),
                         "olfactory": normalize_direction("olfactory", guard),
                         "play": replace_map(normalize_direction("play"), WRESTLE_MAP)})
    return as_lists(df, _TAGS, ";")


def marker_pass(df: DataFrame, timeline: Timeline, fixes: frozenset[str],
                counts: RowCounts | None = None) -> DataFrame:
    """Classify loose end markers, look up the last tag before each row, drop
    removed and unresolved rows, and copy sized markers under a size label.

    Rows are dropped after the look-ups, which skip them: a filter before would
    make the optimizer repeat the whole pairing inside the filter.
    """
    m, several = F.col("modifiers"), F.col("several")
    flag = two_small()
    residue = residual_text() if "residual_text" in fixes else F.lit(False)
    df = df.withColumns({
        "tiny_only": two_small(), "residue": residue,
        "check": F.when(flag | several & residue, F.lit(True)).otherwise(F.col("check"))})
    stays = ~F.col("gone")
    if "keep_flagged" not in fixes:
        stays = stays & ~F.col("tiny_only") & (~several | F.col("check").isNull())
    df = df.withColumn("stays", stays)
    label = F.col("written") if "near_original" in fixes else F.col("behavior")
    df = timeline.look(df, **near_looks(label, ~F.col("gone")),
                       tag_before=Behind(F.col("last_tag"), F.col("stays")))
    if counts is not None:
        df = counts.before_removal(df, F.col("gone"), F.col("stays"))
    df = df.where(F.col("stays"))
    df = df.withColumns({"sized": is_sized_loose(), "near": is_near(),
                         "wide": F.coalesce(count_pattern(m, ";") > 1, F.lit(False))})
    sized, near, wide = F.col("sized"), F.col("near"), F.col("wide")
    flagged = F.when(wide & F.col("residue"), F.lit(True)).otherwise(F.col("check"))
    lives = sized if "keep_flagged" in fixes else sized & (~wide | flagged.isNull())
    df = df.withColumns({
        "check": F.when(is_loose("behavior") & ~sized, F.lit(True)).otherwise(F.col("check")),
        "copied": lives, "found": sized & ~near})
    size = F.when(near, size_label(m, DIG_PREFIX, lone_tiny=False)).otherwise(
        size_label(m, FOUND_PREFIX, lone_tiny=False))
    df = duplicate_where(df, F.col("copied"), "marker_rank", {
        "behavior": F.coalesce(size, F.col("behavior")), "several": several | wide,
        "check": flagged})
    return df.drop("gone", "stays", "written", "sized", "near", "wide", "residue",
                   "tiny_only", *NEAR_COLUMNS)


def split_sizes(df: DataFrame, fixes: frozenset[str]) -> DataFrame:
    """One row per size; only the first row of a place follows the row before."""
    found = F.col("found") if "fa_multi" in fixes else None
    df = explode_sizes(df, F.col("several") & F.col("check").isNull(), found=found)
    first = (F.col("size_pos") == 0) & ((F.col("marker_rank") == 0) | ~F.col("copied"))
    return (df.withColumn("tag_before", F.when(first, F.col("tag_before"))
                          .otherwise(F.col("last_tag")))
            .drop("last_tag", "several", "found", "copied"))


def split_tags(df: DataFrame) -> DataFrame:
    """One row per place in the tag lists, outcomes attached to what they end.

    The tag before a piece is its left neighbour in the list, or for the first
    piece the last one of the row before.
    """
    lists = [f"__l_{c}" for c in _TAGS]
    df = df.withColumn("piece_pos", places(lists))
    before = F.when(
        F.col("piece_pos") == 0, F.col("tag_before")).otherwise(
        piece(F.col("__l_agg_sub"), F.col("piece_pos") - 1))
    df = df.withColumn("tag_before", before).withColumns(
        {c: piece(F.col(f"__l_{c}"), F.col("piece_pos")) for c in _TAGS}).drop(*lists)
    df = trim_all(df)
    return df.withColumn("agg_sub", outcome_of(F.col("agg_sub"), F.col("tag_before"))).drop(
        "tag_before")


def tags_to_labels(df: DataFrame, fixes: frozenset[str]) -> DataFrame:
    """One row per tag; tags become labels, beside or in place of the label."""
    df = df.withColumn("ob", merge_tags(_TAGS))
    df = explode_tokens(df, "ob", "; ", "ob", "tag_pos")
    label, ob = F.col("behavior"), F.col("ob")
    category = label.isin(*CATEGORIES)
    tagged = (ob != "") & ~category
    df = duplicate_where(df.withColumn("__category", category), tagged, "tag_rank",
                         {"behavior": ob})
    df = df.withColumn("behavior", F.when(F.col("__category"), ob).otherwise(F.col("behavior")))
    if "dedup_original" in fixes:
        again = (F.col("piece_pos") > 0) | (F.col("tag_pos") > 0)
        extra = F.coalesce(~F.col("__category"), F.lit(False)) & (F.col("tag_rank") == 1) & again
        df = df.where(~extra)
    df = explode_conditional(df.drop("__category"), splits_approach(), ";")
    return df.withColumns({c: trim_blanks(c) for c in ("behavior", "ob")})


def finalize(df: DataFrame, fixes: frozenset[str]) -> DataFrame:
    spent = F.col("end_sec") - F.col("st_sec")
    if "rollover" in fixes:
        spent = F.when(spent < 0, spent + SECONDS_PER_DAY).otherwise(spent)
    df = df.withColumns({
        "s_duration": spent, "st_time": format_clock("st_sec"),
        "end_time": format_clock("end_sec"), "duration": format_clock(spent),
        "date_text": date_text("date"), "row_order": F.struct(*ROW_ORDER)})
    df = df.drop(*ROW_ORDER, "st_sec", "end_sec", "date", "ob")
    return order_columns(df, ["session_id", "row_order", *REPORT_HEADINGS])


def report(events: DataFrame, keep_order: bool = False) -> DataFrame:
    """The event table under its report headings."""
    named = events.withColumnsRenamed(REPORT_HEADINGS)
    return named if keep_order else named.drop("row_order")
