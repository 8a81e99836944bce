"""Queries over state intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace import functions as fx
from fieldtrace.operators import (FAMILIES, FamilySpec, dig_intervals, ended_by_other,
                                  long_sessions, per_session, row_sequence, state_intervals)
from fieldtrace.operators.intervals import Fields, odd_dig_end
from fieldtrace.plans.event_table import normalize

from .base import has, query, semis, table
from .script import IN_TURN, LOG_SQL, SCATTERED, scattered, scripted_log
from .table import BY_OTHER_SQL, DIG_SQL, FAMILY_SQL, NONE, RAW_SQL, family_sql, one_size

VALUES = ("end_sec", "duration", "modifiers", "comments", "check", "removed")
VALUES_SQL = 'end_sec, duration, modifiers, comments, check_flag AS "check", removed'


def _log(spark, sf_dir, place=IN_TURN):
    log, long = scripted_log(spark, sf_dir, place)
    rows = normalize(log).select("session_id", "seq", "st_sec", "behavior", "modifiers",
                                 "comments", "check")
    return rows, long


def _families(spark, sf_dir, *names, place=IN_TURN):
    rows, long = _log(spark, sf_dir, place)
    return per_session(
        rows, lambda df, line: state_intervals(df, line, [FAMILIES[n] for n in names]), long=long)


def _one_family(spark, sf_dir, name, place=IN_TURN):
    done = _families(spark, sf_dir, name, place=place).where(F.col(name).isNotNull())
    return done.select("session_id", "seq", *[F.col(name)[v].alias(v) for v in VALUES])


def _family_sql(name):
    return f"WITH {RAW_SQL}, {FAMILY_SQL[name]} SELECT session_id, seq, {VALUES_SQL} FROM {name}"


def _register_scattered(name):
    @query(scattered(_family_sql(name)), name=f"state_{name}_scattered")
    def over_scattered_rows(spark, sf_dir):
        return _one_family(spark, sf_dir, name, SCATTERED)


for _name in FAMILIES:
    _register_scattered(_name)


CLICKS_SQL = f"""WITH raw AS (
  SELECT user_id AS session_id, event_type AS behavior, CAST(NULL AS VARCHAR) AS modifiers,
         CAST(NULL AS VARCHAR) AS comments, {NONE} AS check_flag,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS st_sec,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
{family_sql('click', 'click', has('behavior', 'click', 'purchase'),
            "CASE WHEN followed THEN nt WHEN NOT is_end THEN st_sec + 1 END", "followed",
            "check_flag", "ck IS NULL").replace("click; End", "purchase")}
SELECT session_id, seq, end_sec, duration, removed FROM click"""


@query(CLICKS_SQL)
def state_pair_point(spark, sf_dir):
    """How long did each click last until the purchase, per user?"""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id",
        F.col("event_type").alias("behavior"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
        .alias("st_sec"))
    long = long_sessions(events.select("session_id"), ["session_id"])
    rows = row_sequence(events, ["session_id"], ["ts", "event_id"], long=long)
    spec = FamilySpec("click", "click|purchase", "purchase", unpaired="point", end_pairs=True)
    fields = Fields(modifiers=None, comments=None, check=None)
    done = per_session(rows, lambda df, line: state_intervals(df, line, [spec], fields), long=long)
    return done.where(F.col("click").isNotNull()).select(
        "session_id", "seq", *[F.col("click")[v].alias(v)
                               for v in ("end_sec", "duration", "removed")])


@query(_family_sql("ga"))
def state_pair_end(spark, sf_dir):
    return _one_family(spark, sf_dir, "ga")


@query(_family_sql("gt"))
def state_run_adjacent(spark, sf_dir):
    return _one_family(spark, sf_dir, "gt")


@query(_family_sql("burr"))
def state_next_row(spark, sf_dir):
    return _one_family(spark, sf_dir, "burr")


@query(_family_sql("inburr"))
def state_pair_flag(spark, sf_dir):
    return _one_family(spark, sf_dir, "inburr")


@query(_family_sql("oov"))
def state_pair_reset(spark, sf_dir):
    return _one_family(spark, sf_dir, "oov")


@query(f"""WITH {RAW_SQL}, {BY_OTHER_SQL}
SELECT session_id, seq, {VALUES_SQL} FROM by_other""")
def state_end_by_other(spark, sf_dir):
    rows, long = _log(spark, sf_dir)
    done = per_session(rows, ended_by_other, long=long).where(F.col("by_other").isNotNull())
    return done.select("session_id", "seq", *[F.col("by_other")[v].alias(v) for v in VALUES])


def _digs(spark, sf_dir, place=IN_TURN):
    rows, long = _log(spark, sf_dir, place)
    return per_session(rows, dig_intervals, long=long).where(F.col("dig").isNotNull())


DIGS_SQL = f"WITH {RAW_SQL}, {BY_OTHER_SQL}, {DIG_SQL}"


STATE_DIG_SQL = f"{DIGS_SQL} SELECT session_id, seq, {VALUES_SQL}, named AS label, several FROM dig"


def _dig_values(digs):
    return digs.select(
        "session_id", "seq", *[F.col("dig")[v].alias(v) for v in (*VALUES, "label", "several")])


@query(STATE_DIG_SQL)
def state_dig(spark, sf_dir):
    return _dig_values(_digs(spark, sf_dir))


@query(scattered(STATE_DIG_SQL))
def state_dig_scattered(spark, sf_dir):
    return _dig_values(_digs(spark, sf_dir, SCATTERED))


@query(f"{DIGS_SQL} SELECT session_id, seq, modifiers FROM dig WHERE modifiers = 'success'")
def default_outcome(spark, sf_dir):
    digs = _digs(spark, sf_dir).select(
        "session_id", "seq", F.col("dig")["modifiers"].alias("modifiers"))
    return digs.where(F.col("modifiers") == "success")


@query(f"""{DIGS_SQL} SELECT r.session_id, r.seq, r.behavior FROM raw r
LEFT JOIN dig d USING (session_id, seq) WHERE d.removed IS NULL""")
def drop_unsized_end(spark, sf_dir):
    rows, long = _log(spark, sf_dir)
    done = per_session(rows, dig_intervals, long=long)
    return done.where(F.col("dig")["removed"].isNull()).select("session_id", "seq", "behavior")


# All families side by side.
NAMES = tuple(FAMILIES)
ALL = (*NAMES, "by_other", "dig")
ALL_SQL = f"WITH {RAW_SQL}, {', '.join(FAMILY_SQL.values())}, {BY_OTHER_SQL}, {DIG_SQL}"
_JOINS = " ".join(f"LEFT JOIN {n} USING (session_id, seq)" for n in ALL)


def _all_families(spark, sf_dir):
    rows, long = _log(spark, sf_dir)

    def work(df, line):
        done = state_intervals(df, line, list(FAMILIES.values()))
        done = ended_by_other(line.settle(done), line)
        return dig_intervals(line.settle(done), line)

    return per_session(rows, work, long=long)


@query(f"""{ALL_SQL} SELECT r.session_id, r.seq, {', '.join(f'{n}.duration AS {n}' for n in ALL)}
FROM raw r {_JOINS}""")
def interval_duration(spark, sf_dir):
    """What each family says the row lasts."""
    return _all_families(spark, sf_dir).select(
        "session_id", "seq", *[F.col(n)["duration"].alias(n) for n in ALL])


@query(f"""{ALL_SQL} SELECT r.session_id, r.seq, r.behavior FROM raw r {_JOINS}
WHERE {' AND '.join(f'{n}.removed IS NULL' for n in NAMES)}""")
def drop_end_markers(spark, sf_dir):
    done = _all_families(spark, sf_dir)
    for n in NAMES:
        done = done.where(F.col(n)["removed"].isNull())
    return done.select("session_id", "seq", "behavior")


# The families that hand notes on, strongest first.
NOTED = ("dig", "oov", "burr", "gt", "inburr", "ga")


def _inherit_sql(field):
    return f"""{ALL_SQL}
SELECT r.session_id, r.seq, coalesce({', '.join(f'{n}.{field}' for n in NOTED)}, r.{field}) AS {field}
FROM raw r {_JOINS}"""


def _inherit(spark, sf_dir, field):
    return _all_families(spark, sf_dir).select("session_id", "seq", F.coalesce(
        *[F.col(n)[field] for n in NOTED], F.col(field)).alias(field))


@query(_inherit_sql("modifiers"))
def inherit_modifiers(spark, sf_dir):
    return _inherit(spark, sf_dir, "modifiers")


@query(_inherit_sql("comments"))
def inherit_comments(spark, sf_dir):
    return _inherit(spark, sf_dir, "comments")


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, {one_size('d.', 'modifiers', True)} AS dug,
  {one_size('fa.', 'modifiers', False)} AS found FROM log""")
def size_label(spark, sf_dir):
    return _log(spark, sf_dir)[0].select(
        "session_id", "seq", fx.size_label("modifiers", "d.", lone_tiny=True).alias("dug"),
        fx.size_label("modifiers", "fa.", lone_tiny=False).alias("found"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, {has('behavior', 'Dig; End')} AND coalesce(behavior, '') NOT IN
  ('Dig; End (+Modifiers)', 'Re-Dig; End (+Modifiers)', 'Other vig.; Dig; End (+Modifiers)',
   'Other vig.; Re-Dig; End (+Modifiers)') AS odd, {semis('modifiers')} > 1 AS several
FROM log""")
def flag_compound(spark, sf_dir):
    rows = _log(spark, sf_dir)[0]
    return rows.select("session_id", "seq", odd_dig_end("behavior").alias("odd"),
                       (fx.count_pattern("modifiers", ";") > 1).alias("several"))
