"""A scripted observation log laid over the ``events`` table.

Each user is a session, its events in time order are the rows, and a fixed
script gives the row at each place its coded cells, so that every rule of the
protocol is met at every scale.  The same log is stated in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.functions import format_clock
from fieldtrace.operators import long_sessions, row_sequence
from fieldtrace.operators.timeline import BLOCK_ROWS

from .base import table

CELLS = ("behavior", "modifiers", "agg_sub", "play", "olfactory", "partner",
         "focal_individual", "pup_care", "comments")


def _row(behavior=None, **cells):
    return tuple({"behavior": behavior, **cells}.get(c) for c in CELLS)


SCRIPT = (
    _row("Start focal", focal_individual="A (M1) Burrow"),
    _row("GA"),
    _row("Nearest neigh."),
    _row("GA; End", modifiers="m1", comments="c1"),
    _row("GA"),
    _row("GT"),
    _row("GT"),
    _row("GT; End", modifiers="m2"),
    _row("GT other"),
    _row("Dig"),
    _row("Dig; End (+Modifiers)", modifiers="Small"),
    _row("Re-Dig"),
    _row("Re-Dig; End (+Modifiers)"),
    _row("Dig"),
    _row("Other vig."),
    _row("Burr/BH renn"),
    _row("In burr/BH"),
    _row("In burr/BH; End", pup_care="y"),
    _row("Out of view"),
    _row("Out of view; End", pup_care="y", comments="c2"),
    _row("Out of view"),
    _row("Play", play="Initiate; Chase", focal_individual="B (M2)(x) Forage"),
    _row("Play", play="Receive; A; B"),
    _row("Aggr./Sub.", agg_sub="Fcomp; Win"),
    _row("Olfactory", olfactory="Receive; S; T"),
    _row("GA", agg_sub="a;b", play="z"),
    _row("Approach;Sniff", partner="X"),
    _row("Receive approach", partner="Receive; X"),
    _row("i.groom", partner="Initiate; Receive; X"),
    _row("groom", partner="Recieve; Reciprocate; Y"),
    _row("i.groom", partner="X"),
    _row("Dig"),
    _row("Dig; End (+Modifiers)", modifiers="Small; Large; Tiny; >5"),
    _row("End (+Modifiers)", modifiers="Medium"),
    _row("Other vig."),
    _row("End (+Modifiers)", modifiers="Tiny; <5"),
    _row("End (+Modifiers)"),
    _row("Dig"),
    _row("Dig; End (+Modifiers)", modifiers="1; Tiny; 2; Tiny"),
    _row(None, play="Wrestle; Bottom", focal_individual="Burrow and Forage"),
    _row("Dig"),
    _row("Dig; End (+Modifiers)", modifiers="Small; Medium; 3"),
    _row("Other vig."),
    _row("End (+Modifiers)", modifiers="Small"),
    _row("Other vig.; Dig; End (+Modifiers)"),
    _row("Nearest neigh."),
    _row("Other vig."),
    _row("End (+Modifiers)", modifiers="Large"),
    _row("End Focal"),
    _row("Play"),
    # Further cases: an end marker followed by a re-dig end, comments that
    # stay or move, a null label after a renovation, a label of two families,
    # several sizes on a loose marker, blanks to trim.
    _row("Dig; End (+Modifiers)", comments="own"),
    _row("Re-Dig; End (+Modifiers)", modifiers="Tiny", comments="c3"),
    _row("Burr/BH renn", comments="own"),
    _row("Burr/BH renn; End", modifiers="m3", comments="c4"),
    _row("In burr/BH", modifiers="own"),
    _row("In burr/BH; End", modifiers="m4", comments="c5"),
    _row("GA", comments="own"),
    _row("GA; End", pup_care="y", comments="c6"),
    _row("Burr/BH renn"),
    _row(None, agg_sub=" Fcomp ", partner="Receive; Initiate"),
    _row("Aggr./Sub.", agg_sub="Win; Lose"),
    _row("End (+Modifiers)", modifiers="Small; Large; 2"),
    _row("Out of view GA", modifiers="mm", partner=" Receive;  Z; Reciprocate "),
    _row("GA; End", modifiers="m5"),
    _row("Approach; Sniff ; ", partner="Receive; Initiate"),
    _row("Dig", play="Initiate; Receive", agg_sub="Receive; V; W; U", olfactory=""),
    _row("Re-Dig; End now", modifiers="Medium; 1"),
    _row("Dig; End (+Modifiers)", modifiers="Tiny; >5; 1; <5; x"),
    _row(" groom ", partner="Receive; Initiate; W"),
)
DICTIONARY = (
    ("groom", "i.groom", 1), ("GROOM", "never", 2), ("initiate chase", "i.chase", 3),
    ("receive a", "r.a", 4), ("sniff", "i.sniff", 5), ("approach", "i.approach", 6),
    ("fcomp win", "fcomp.win", 7), ("end focal", None, 8),
)


# The place in the script, in turn or scattered so that neighbours vary.
IN_TURN = "(seq + session_id)"
SCATTERED = "(event_id * 37 + session_id * 11 + seq * seq)"


def scripted_log(spark: SparkSession, sf_dir: str, place: str = IN_TURN,
                 limit: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The log, and its sessions with more than ``limit`` rows (None if there are none)."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id", "event_type")
    long = long_sessions(events.select("session_id"), ["session_id"], limit)
    rows = row_sequence(events, ["session_id"], ["ts", "event_id"], long=long)
    return lay_script(rows, place), long


def lay_script(rows: DataFrame, place: str = IN_TURN) -> DataFrame:
    cells = rows.sparkSession.sql(
        f"SELECT * FROM VALUES {_values((i, *r) for i, r in enumerate(SCRIPT))} "
        f"AS script(idx, {', '.join(CELLS)})")
    timed = rows.selectExpr(
        "*", f"cast({place} % {len(SCRIPT)} AS int) AS idx",
        "21600 + 13 * seq + event_id % 7 AS __sec")
    timed = timed.withColumn("__clock", format_clock("__sec"))
    # One row per place of the script, so the size of this side is fixed.
    return timed.join(F.broadcast(cells), "idx", "left").selectExpr(
        "session_id", "seq", "date_add(DATE'2024-01-01', cast(session_id % 300 AS int)) AS date",
        """CASE WHEN session_id % 2 = 0 THEN cast(__sec / 86400.0D AS string)
           ELSE concat('1899-12-31 ', __clock) END AS time_raw""",
        "concat('t', seq % 5, ' ') AS time_2", "concat(' obs ', session_id % 3) AS observer",
        "event_type AS groups", *CELLS, "CASE WHEN session_id % 3 > 0 THEN 'f' END AS sex",
        "concat('h', session_id % 2) AS life_history",
        "concat('r', seq % 4, ' ') AS time_spent_running")


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT behavior, replacement, cast(dict_seq AS bigint) AS dict_seq "
                     f"FROM VALUES {_values(DICTIONARY)} AS t(behavior, replacement, dict_seq)")


# -- the same in SQL -----------------------------------------------------------

def _lit(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ",\n    ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)


# CTE ``log``: the scripted log with ``st_sec`` and a null ``check_flag``.
_IN_TURN_SQL = "(n.seq + n.session_id)"
_SCATTERED_SQL = "(n.event_id * 37 + n.session_id * 11 + n.seq * n.seq)"
LOG_SQL = f"""script(idx, {', '.join(CELLS)}) AS (VALUES
    {_values([(i, *r) for i, r in enumerate(SCRIPT)])}),
numbered AS (
  SELECT user_id AS session_id, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events),
log AS (
  SELECT n.session_id, n.seq, DATE '2024-01-01' + CAST(n.session_id % 300 AS INTEGER) AS date,
         21600 + 13 * n.seq + n.event_id % 7 AS st_sec,
         't' || (n.seq % 5) || ' ' AS time_2, CASE WHEN n.session_id % 3 > 0 THEN 'f' END AS sex,
         ' obs ' || (n.session_id % 3) AS observer, n.event_type AS groups,
         {', '.join('s.' + c for c in CELLS)},
         'h' || (n.session_id % 2) AS life_history, 'r' || (n.seq % 4) || ' ' AS time_spent_running
  FROM numbered n JOIN script s ON s.idx = {_IN_TURN_SQL} % {len(SCRIPT)})"""


def scattered(sql: str) -> str:
    """The same statement over the scattered log."""
    return sql.replace(_IN_TURN_SQL, _SCATTERED_SQL)


DICTIONARY_SQL = f"""dictionary(behavior, replacement, dict_seq) AS (VALUES
    {_values(DICTIONARY)}),
entries AS (
  SELECT key, replacement FROM (
    SELECT lower(behavior) AS key, replacement,
           row_number() OVER (PARTITION BY lower(behavior) ORDER BY dict_seq) AS place
    FROM dictionary) WHERE place = 1)"""
