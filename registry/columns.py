"""Queries over projections, typing, time, conditions and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace import functions as fx
from fieldtrace import operators as op
from fieldtrace.operators.intervals import is_scan_only
from fieldtrace.vocabulary import DIRECTION_MAP, WRESTLE_MAP

from .base import has, hits, query, semis, table
from .script import LOG_SQL, scripted_log

CLOCK_SQL = ("printf('%02d:%02d:%02d', (o_orderkey * 37 % 86400) // 3600, "
             "(o_orderkey * 37 % 86400) // 60 % 60, (o_orderkey * 37 % 86400) % 60)")


def _clock_texts(spark, sf_dir):
    """Orders with a written time: prefixed, bare or broken; and a day fraction."""
    sec = F.col("o_orderkey") * 37 % 86400
    clock = fx.format_clock(sec)
    key = F.col("o_orderkey") % 5
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key == 0, clock).when(key == 1, F.concat(clock, F.lit("x")))
        .otherwise(F.concat(F.lit("1899-12-31 "), clock)).alias("clock"),
        (F.col("o_totalprice") / 1000000).cast("string").alias("fraction"))


CLOCKS_SQL = f"""clocks AS (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {CLOCK_SQL} WHEN 1 THEN {CLOCK_SQL} || 'x'
    ELSE '1899-12-31 ' || {CLOCK_SQL} END AS clock, o_totalprice / 1000000 AS day FROM orders)"""
SECONDS_SQL = "CASE WHEN o_orderkey % 5 <> 1 THEN o_orderkey * 37 % 86400 END"
DAY_SQL = "CASE WHEN day < 1 THEN CAST(round_even(day * 86400, 0) AS BIGINT) END"


@query(f"WITH {CLOCKS_SQL} SELECT o_orderkey, {DAY_SQL} AS sec FROM clocks")
def time_fraction(spark, sf_dir):
    return _clock_texts(spark, sf_dir).select(
        "o_orderkey", fx.fraction_to_seconds("fraction").alias("sec"))


@query(f"SELECT o_orderkey, {SECONDS_SQL} AS sec FROM orders")
def time_text(spark, sf_dir):
    return _clock_texts(spark, sf_dir).select(
        "o_orderkey", fx.clock_to_seconds("clock").alias("sec"))


@query(f"""WITH {CLOCKS_SQL} SELECT o_orderkey,
  CASE WHEN o_orderkey % 2 = 0 THEN {DAY_SQL} ELSE {SECONDS_SQL} END AS sec FROM clocks""")
def time_normalize(spark, sf_dir):
    rows = _clock_texts(spark, sf_dir)
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.col("fraction")).otherwise(F.col("clock"))
    return rows.select("o_orderkey", fx.normalize_time(mixed).alias("sec"))


@query("""SELECT n_nationkey AS sheet, n_name AS "Focal individual", n_regionkey AS grp FROM nation""")
def rename_cols(spark, sf_dir):
    return op.rename_columns(table(spark, sf_dir, "nation"), {
        "n_nationkey": "sheet", "n_name": "Focal individual", "n_regionkey": "grp"})


@query("""SELECT p_partkey, p_name, p_brand, p_type AS kind, p_size AS extent, p_retailprice
FROM part""")
def rename_suffix(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    by_suffix = op.rename_matching(part, "kind", suffix="_TYPE")
    return op.rename_matching(by_suffix, "extent", prefix="P_Size")


@query("""SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  CAST(l_partkey AS VARCHAR) AS l_partkey, l_returnflag FROM lineitem""")
def cast_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return op.cast_columns(rows, ["l_linenumber", "l_partkey"])


@query("""SELECT s_name, s_suppkey, * EXCLUDE (s_name, s_suppkey), CAST(NULL AS BIGINT) AS end_sec,
  CAST(NULL AS BOOLEAN) AS flag FROM supplier""")
def column_order(spark, sf_dir):
    rows = op.null_columns(table(spark, sf_dir, "supplier"),
                           {"end_sec": "bigint", "flag": "boolean"})
    return op.order_columns(rows, ["s_name", "s_suppkey"])


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def month_part(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.month("o_orderdate").alias("month"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s < 0 THEN '-' ELSE '' END ||
  printf('%02d:%02d:%02d', abs(s) // 3600, abs(s) // 60 % 60, abs(s) % 60) AS clock
FROM (SELECT l_orderkey, l_linenumber, l_partkey * 97 - 9000 AS s FROM lineitem)""")
def clock_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        fx.format_clock(F.col("l_partkey") * 97 - 9000).alias("clock"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
  strftime(o_orderdate, '%m/%d/%Y') AS text FROM orders""")
def date_text(spark, sf_dir):
    written = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"),
                       F.when(F.col("o_orderkey") % 2 == 0, F.lit(" 12:00:00 AM"))
                       .otherwise(F.lit("")))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", fx.clean_date(written).alias("date"))
    return rows.withColumn("text", fx.date_text("date"))


def _log(spark, sf_dir):
    return scripted_log(spark, sf_dir)[0]


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, {has('behavior', 'GA')} AS is_ga,
  NOT {has('behavior', 'Dig')} AND {has('modifiers', 'Small', 'Tiny')} AS sized_only,
  {hits('behavior', '^Approach')} AS approach, {hits('modifiers', '[a-z]')} AS lower FROM log""")
def null_safe_match(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "session_id", "seq", fx.matches("behavior", "GA").alias("is_ga"),
        (~fx.matches("behavior", "Dig") & fx.matches("modifiers", "Small|Tiny"))
        .alias("sized_only"),
        fx.matches("behavior", "^Approach").alias("approach"),
        fx.matches("modifiers", "[a-z]").alias("lower"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq,
  CASE WHEN contains(behavior, 'Dig') AND contains(modifiers, 'Small') THEN 'small dig'
       WHEN contains(behavior, 'Dig') THEN 'dig' WHEN contains(behavior, 'End') THEN 'end' END AS kind,
  CASE WHEN contains(modifiers, 'Tiny') THEN 'tiny' ELSE 'rest' END AS size FROM log""")
def case_label(spark, sf_dir):
    dig = F.col("behavior").contains("Dig")
    return _log(spark, sf_dir).select(
        "session_id", "seq",
        fx.when_chain([(dig & F.col("modifiers").contains("Small"), F.lit("small dig")),
                       (dig, F.lit("dig")),
                       (F.col("behavior").contains("End"), F.lit("end"))]).alias("kind"),
        fx.when_chain([(F.col("modifiers").contains("Tiny"), F.lit("tiny"))], F.lit("rest"))
        .alias("size"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq,
  CASE WHEN contains(partner, 'Receive') THEN 'shared' WHEN NOT contains(partner, 'Receive')
       THEN 'own' END AS side FROM log""")
def na_ifelse(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "session_id", "seq",
        fx.na_ifelse(F.col("partner").contains("Receive"), F.lit("shared"), F.lit("own"))
        .alias("side"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, behavior FROM log
WHERE NOT coalesce({hits('behavior', 'Nearest neigh.|Other vig.')} AND {semis('behavior')} = 0, false)""")
def drop_scan_rows(spark, sf_dir):
    rows = _log(spark, sf_dir).select("session_id", "seq", "behavior")
    return rows.where(~is_scan_only(F.col("behavior")))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, pup_care,
  CASE WHEN pup_care IS NOT NULL THEN true END AS "check" FROM log""")
def review_flag(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "session_id", "seq", "pup_care",
        fx.review_flag("pup_care", F.lit(None).cast("boolean")).alias("check"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(text, '\\(([^()]*)\\)', 1), '') AS inside
FROM (SELECT doc_id, replace(replace(text, 'a', '('), 'e', ')') AS text FROM documents)""")
def extract_bracketed(spark, sf_dir):
    text = F.translate("text", "ae", "()")
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.extract_bracketed(text).alias("inside"))


@query(f"""SELECT doc_id, CASE WHEN {has('text', 'the')} AND {has('text', 'der')} THEN 'the; der'
  WHEN {has('text', 'the')} THEN 'the' WHEN {has('text', 'der')} THEN 'der' END AS words
FROM documents""")
def keyword_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.keyword_label("text", ["the", "der"]).alias("words"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, CAST(month(date) AS VARCHAR) || '.' || seq || '.'
  || coalesce(modifiers, 'NA') AS id FROM log""")
def compose_id(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "session_id", "seq", fx.compose_id([F.month("date"), "seq", "modifiers"]).alias("id"))


@query("""SELECT doc_id, regexp_replace(text, '[aeiou]+', '_', 'g') AS masked,
  replace(text, 'en', 'EN') AS upper FROM documents""")
def replace_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace("text", "[aeiou]+", "_").alias("masked"),
        F.replace("text", F.lit("en"), F.lit("EN")).alias("upper"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq,
  replace(replace(play, 'Initiate;', 'Initiate'), 'Receive;', 'Receive') AS directed,
  replace(replace(play, 'Wrestle; Bottom', 'Wrestle Bottom'), 'Wrestle; Top', 'Wrestle Top') AS wrestle
FROM log""")
def replace_map(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "session_id", "seq", fx.replace_map("play", DIRECTION_MAP).alias("directed"),
        fx.replace_map("play", WRESTLE_MAP).alias("wrestle"))


@query("""SELECT doc_id, CAST(length(text) - length(replace(text, '.', '')) AS INTEGER) AS stops,
  CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS numbers FROM documents""")
def count_pattern(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.count_pattern("text", r"\.").alias("stops"),
        fx.count_pattern("text", "[0-9]+").alias("numbers"))


@query("""SELECT doc_id, regexp_replace(text, 'en|er', '#') AS once,
  regexp_replace(text, '[0-9]', '', 'g') AS bare FROM documents""")
def replace_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.replace_first("text", "en|er", "#").alias("once"),
        fx.remove_all("text", "[0-9]").alias("bare"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, trim(observer, ' ' || chr(9)) AS observer,
  trim(behavior, ' ' || chr(9)) AS behavior, trim(partner, ' ' || chr(9)) AS partner FROM log""")
def trim_all(spark, sf_dir):
    return op.trim_all(_log(spark, sf_dir).select(
        "session_id", "seq", "observer", "behavior", "partner"))


def _direction_sql(col: str, guard: str) -> str:
    joined = f"replace(replace({col}, 'Initiate;', 'Initiate'), 'Receive;', 'Receive')"
    directed = has(col, "Initiate; ", "Receive; ")
    return (f"CASE WHEN {hits(col, '^Receive; ')} AND {semis(col)} <> 1 AND NOT "
            f"{has(guard, 'Initiate')} THEN replace({joined}, ';', '; Receive') "
            f"WHEN {directed} THEN {joined} ELSE {col} END")


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, {_direction_sql('play', 'play')} AS play,
  {_direction_sql('agg_sub', 'play')} AS guarded, {_direction_sql('agg_sub', 'agg_sub')} AS own,
  {_direction_sql('olfactory', 'play')} AS olfactory FROM log""")
def normalize_direction(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "session_id", "seq", fx.normalize_direction("play").alias("play"),
        fx.normalize_direction("agg_sub", F.col("play")).alias("guarded"),
        fx.normalize_direction("agg_sub").alias("own"),
        fx.normalize_direction("olfactory", F.col("play")).alias("olfactory"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, concat_ws('; ', agg_sub, play, olfactory) AS ob
FROM log""")
def merge_tags(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "session_id", "seq", fx.merge_tags(["agg_sub", "play", "olfactory"]).alias("ob"))
