"""Queries over sessions: sources, sinks, numbering, running state, look-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldtrace import sources
from fieldtrace.functions import normalize_time
from fieldtrace.operators import (Ahead, Behind, Timeline, fill_down, long_sessions,
                                  per_session, relabel, row_sequence, running_counter)
from fieldtrace.operators.timeline import shared_folder
from fieldtrace.vocabulary import DATE_SUFFIX

from .base import query, table
from .script import CELLS, DICTIONARY_SQL, LOG_SQL, dictionary, scripted_log


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    return rows, long_sessions(rows.select("session_id"), ["session_id"])


@query("""SELECT user_id AS session_id, event_id, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""")
def session_source(spark, sf_dir):
    """Events as sessions: one frame, one numbered session per user."""
    rows, long = _events(spark, sf_dir)
    rows = rows.select("session_id", "ts", "event_id", "event_type", "value")
    return row_sequence(rows, ["session_id"], ["ts", "event_id"], long=long).drop("ts")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS seq
FROM conversations""", name="row_sequence")
def query_row_sequence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    long = long_sessions(rows, ["conv_id"])
    return row_sequence(rows, ["conv_id"], ["turn", "role"], long=long).drop("role")


@query("""SELECT c_custkey, c_nationkey AS sheet_no, n_name AS session_id
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey BETWEEN 2 AND 20""")
def session_names(spark, sf_dir):
    """Sheets 2 to 20, named by position from a catalogue."""
    sheets = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("sheet_no"))
    catalogue = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("sheet_no"), F.col("n_name").alias("session_id"))
    return sources.name_sessions(sheets, catalogue, first=2, last=20)


@query("""SELECT event_type AS session_id, event_id, value,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events""")
def sink_roundtrip(spark, sf_dir):
    """Write one directory per session, read it back, number by place in the file."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("session_id"), "event_id", "ts", "value")
    path = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    sources.write_sessions(rows, path, order=("ts", "event_id"), ranged=True)
    schema = "event_id bigint, ts timestamp_ntz, value double, session_id string"
    back = sources.read_sessions(spark, path, schema=schema)
    return back.select("session_id", "event_id", "value", "seq")


PARTIAL_SQL = """WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_id,
    CASE WHEN user_id % 3 = 1 THEN -1.0 ELSE value END AS value
  FROM events WHERE NOT (user_id % 3 = 2))
SELECT layout, e.* FROM e, (VALUES ('apart'), ('shared')) AS l(layout)"""


@query(PARTIAL_SQL)
def sink_partial(spark, sf_dir):
    """Write all sessions, then some of them again, some of these without rows; in
    directories of their own and in shared ones.  The others stay."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), "event_id", "ts", "value")
    kind = F.col("session_id").cast("bigint") % 3
    again = rows.where(kind != 0).select("session_id").distinct()
    new = rows.where(kind == 1).withColumn("value", F.lit(-1.0))
    schema, parts = "session_id string, event_id bigint, ts timestamp_ntz, value double", []
    for layout, buckets in (("apart", None), ("shared", 5)):
        path = f"{shared_folder(spark)}/partial-{uuid.uuid4().hex}"
        sources.write_sessions(rows, path, order=("ts", "event_id"), ranged=True, buckets=buckets)
        sources.write_sessions(new, path, order=("ts", "event_id"), ranged=True, sessions=again)
        with sources.listed_in_bulk(spark):
            back = spark.read.schema(schema).parquet(path)
        parts.append(back.select(F.lit(layout).alias("layout"), "session_id", "event_id", "value"))
    return parts[0].unionByName(parts[1])


@query(f"""WITH {LOG_SQL} SELECT session_id, seq,
  last_value(modifiers IGNORE NULLS) OVER w AS modifiers,
  last_value(focal_individual IGNORE NULLS) OVER w AS focal_individual
FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq)""", name="fill_down")
def query_fill_down(spark, sf_dir):
    log, long = scripted_log(spark, sf_dir)
    cols = ["modifiers", "focal_individual"]
    return per_session(log.select("session_id", "seq", *cols),
                       lambda df, line: fill_down(df, line, cols), long=long)


@query("""SELECT session_id, seq, event_type,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq)
       AS BIGINT) AS counter
FROM (SELECT user_id AS session_id, event_type,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)""", name="running_counter")
def query_running_counter(spark, sf_dir):
    rows, long = _events(spark, sf_dir)
    rows = row_sequence(rows.select("session_id", "ts", "event_id", "event_type"),
                        ["session_id"], ["ts", "event_id"], long=long)
    counted = per_session(
        rows, lambda df, line: running_counter(df, line, F.col("event_type") == "click"),
        long=long)
    return counted.select("session_id", "seq", "event_type", "counter")


@query("""SELECT session_id, seq,
  lead(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS next_click,
  lag(CASE WHEN event_type = 'view' THEN value END, 1 IGNORE NULLS) OVER w AS last_view,
  lag(CASE WHEN event_type = 'view' THEN value END, 2 IGNORE NULLS) OVER w AS view_before,
  lag(event_type) OVER w AS previous
FROM (SELECT user_id AS session_id, event_type, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
WINDOW w AS (PARTITION BY session_id ORDER BY seq)""")
def subset_lead(spark, sf_dir):
    """Next and earlier members of a subset, without filter or join."""
    rows, long = _events(spark, sf_dir)
    rows = row_sequence(rows.select("session_id", "ts", "event_id", "event_type", "value"),
                        ["session_id"], ["ts", "event_id"], long=long)
    kind, value = F.col("event_type"), F.col("value")

    def work(df, line: Timeline):
        return line.look(df, next_click=Ahead(value, kind == "click"),
                         view=Behind(value, kind == "view", depth=2), previous=Behind(kind))

    return per_session(rows, work, long=long).select(
        "session_id", "seq", "next_click", F.col("view_1").alias("last_view"),
        F.col("view_2").alias("view_before"), "previous")


@query(f"""WITH {LOG_SQL}
SELECT session_id, seq, behavior,
  row_number() OVER (PARTITION BY session_id ORDER BY behavior NULLS FIRST, seq) AS row_no FROM log""")
def ordered_output(spark, sf_dir):
    """Order as data: a dense place for every row, by label and position."""
    log, long = scripted_log(spark, sf_dir)
    return row_sequence(log.select("session_id", "seq", "behavior"), ["session_id"],
                        ["behavior", "seq"], "row_no", long=long)


@query("""SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS session_id, event_id,
  row_number() OVER (PARTITION BY CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END
                     ORDER BY ts, event_id) AS seq FROM events""")
def row_sequence_long(spark, sf_dir):
    """One session with a third of all rows, numbered by the way for long sessions."""
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("bigint")
        .alias("session_id"), "ts", "event_id")
    long = long_sessions(rows, ["session_id"], rows.count() // 10)
    return row_sequence(rows, ["session_id"], ["ts", "event_id"], long=long).drop("ts")


RAW_NAMES = {v: k for k, v in sources.sessions.RAW_HEADINGS.items()} | {
    "focal_individual": "The focal individual", "partner": "Sender partner(s)", "time_2": "Time...9"}


@query(f"""WITH {LOG_SQL} SELECT CAST(session_id AS VARCHAR) AS session_id, seq, date, st_sec, time_2,
  observer, groups, {', '.join(CELLS)}, sex, life_history, time_spent_running FROM log""")
def raw_source(spark, sf_dir):
    """The log written as raw tables (headings, date and time as texts, no position,
    one directory per session) and read again."""
    log, long = scripted_log(spark, sf_dir)
    raw = log.withColumn("date", F.concat(F.col("date").cast("string"), F.lit(DATE_SUFFIX)))
    raw = raw.withColumnsRenamed(RAW_NAMES)
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    sources.write_grouped(raw.repartition("session_id").sortWithinPartitions(
        "session_id", "seq").drop("seq"), path)
    back = sources.read_sessions(spark, path, raw=True)
    return back.select(
        F.col("session_id").cast("string").alias("session_id"), "seq", "date",
        normalize_time("time_raw").alias("st_sec"), "time_2", "observer", "groups", *CELLS, "sex",
        "life_history", "time_spent_running")


@query(f"""WITH {LOG_SQL}, {DICTIONARY_SQL}
SELECT l.session_id, l.seq,
  CASE WHEN e.key IS NOT NULL THEN e.replacement ELSE l.behavior END AS behavior
FROM log l LEFT JOIN entries e ON e.key = lower(l.behavior)""")
def dictionary_source(spark, sf_dir):
    """The dictionary written as a file with a header in another column order."""
    path = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    (dictionary(spark).select("dict_seq", "replacement", "behavior").coalesce(1)
     .write.option("header", "true").csv(path))
    words = sources.read_dictionary(spark, path, fmt="csv", options={"header": "true"})
    return relabel(scripted_log(spark, sf_dir)[0].select("session_id", "seq", "behavior"), words)
