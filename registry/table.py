"""The composed event table, with an oracle that follows the staged reading:
filter a family, look ahead inside the filtered rows, lay the result over the
base, one family after another."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtrace.operators import per_session, row_position
from fieldtrace.operators.timeline import settle, shared_folder
from fieldtrace.plans import ROW_ORDER, RowCounts, report
from fieldtrace.plans import event_table as build
from fieldtrace.sources import read_log, write_log, write_sessions, write_table

from .base import has, hits, query, semis
from .script import (DICTIONARY_SQL, IN_TURN, LOG_SQL, SCATTERED, dictionary, scattered,
                     scripted_log)

PATCH = ("end_sec", "duration", "modifiers", "comments", "check_flag")
SIZED = ("Tiny", "Small", "Medium", "Large")
FEW = ("1; Tiny", "2; Tiny", "Tiny; <5")


def family_sql(name: str, start: str, member: str, end_sec: str, paired: str, check: str,
               removed_check: str, note_filter: str = "true") -> str:
    """One family: members only, look ahead, then notes over what is left."""
    end = has("behavior", f"{start}; End")
    return f"""
{name}_rows AS (
  SELECT *, lead(behavior) OVER w AS nb, lead(st_sec) OVER w AS nt, lead(modifiers) OVER w AS nm
  FROM raw WHERE {member}
  WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
{name}_ends AS (
  SELECT *, {end} AS is_end, {has('nb', f'{start}; End')} AS followed FROM {name}_rows),
{name}_done AS (
  SELECT *, {end_sec} AS end_sec, CASE WHEN {paired} THEN nm ELSE modifiers END AS mods,
         {check} AS ck FROM {name}_ends),
{name}_gone AS (
  SELECT *, CASE WHEN {removed_check} AND is_end THEN true END AS removed
  FROM {name}_done WHERE {note_filter}),
{name} AS (
  SELECT session_id, seq, end_sec, end_sec - st_sec AS duration, mods AS modifiers,
         CASE WHEN nc IS NULL THEN comments WHEN nr THEN nc END AS comments,
         ck AS check_flag, removed
  FROM (SELECT *, lead(comments) OVER w AS nc, lead(removed) OVER w AS nr FROM {name}_gone
        WINDOW w AS (PARTITION BY session_id ORDER BY seq)))"""


def lay_sql(new: str, base: str, patch: str, extra: str = "") -> str:
    cols = ", ".join(f"coalesce(p.{c}, b.{c}) AS {c}" for c in PATCH)
    return f"""
{new} AS (
  SELECT b.* EXCLUDE ({', '.join(PATCH)}), {cols}{extra}
  FROM {base} b LEFT JOIN {patch} p USING (session_id, seq)
  WHERE p.removed IS NULL)"""


def one_size(prefix: str, mods: str, lone: bool) -> str:
    whens = [f"WHEN {has(mods, w)} THEN '{prefix}{w.lower()}'" for w in SIZED[1:]]
    whens.append(f"WHEN {has(mods, *FEW)} THEN '{prefix}tiny.few'")
    whens.append(f"WHEN {mods} = 'Tiny; >5' THEN '{prefix}tiny.many'")
    if lone:
        whens.append(f"WHEN {mods} = 'Tiny' THEN '{prefix}tiny'")
    return f"CASE WHEN {semis(mods)} <= 1 THEN CASE {' '.join(whens)} END END"


def direction_sql(col: str, guard: str) -> str:
    joined = f"replace(replace({col}, 'Initiate;', 'Initiate'), 'Receive;', 'Receive')"
    directed = has(col, "Initiate; ", "Receive; ")
    spread = (f"coalesce(starts_with({col}, 'Receive; '), false) "
              f"AND NOT ({directed} AND {semis(col)} = 1) AND NOT {has(guard, 'Initiate')}")
    plain = f"CASE WHEN {directed} THEN {joined} ELSE {col} END"
    return f"CASE WHEN {spread} THEN replace({plain}, ';', '; Receive') ELSE {plain} END"


def bare_direction(col: str) -> str:
    return direction_sql(col, "'Initiate'")


SCAN = "Nearest neigh.|Other vig."
NONE = "CAST(NULL AS BOOLEAN)"

# CTEs up to ``raw``: ids, place, previous label and review flag per row.
RAW_SQL = f"""{LOG_SQL},
ids AS (
  SELECT *, array_to_string(regexp_extract_all(focal_individual, '\\(([^()]*)\\)', 1), '') AS own_id,
         lag(behavior) OVER (PARTITION BY session_id ORDER BY seq) AS previous
  FROM log),
raw AS (
  SELECT * EXCLUDE (own_id), CASE WHEN focal_individual IS NULL THEN NULL ELSE own_id END AS own,
    last_value(CASE WHEN focal_individual IS NULL THEN NULL ELSE own_id END IGNORE NULLS)
      OVER (PARTITION BY session_id ORDER BY seq) AS kmp_id,
    CASE WHEN {has('focal_individual', 'Burrow')} AND {has('focal_individual', 'Forage')}
           THEN 'Burrow; Forage'
         WHEN {has('focal_individual', 'Burrow')} THEN 'Burrow'
         WHEN {has('focal_individual', 'Forage')} THEN 'Forage' END AS location,
    sum(CASE WHEN {has('behavior', 'Start focal')} THEN 1 ELSE 0 END)
      OVER (PARTITION BY session_id ORDER BY seq) AS focal_no,
    CASE WHEN pup_care IS NOT NULL THEN true END AS check_flag
  FROM ids)"""

FAMILY_SQL = {
    "ga": family_sql(
        "ga", 'GA', has('behavior', 'GA'),
            "CASE WHEN followed THEN nt WHEN NOT is_end THEN st_sec + 1 END",
            "followed", "check_flag", "ck IS NULL"),
    "gt": family_sql(
        "gt", 'GT', has('behavior', 'GT') + " AND " + has('previous', 'GT')
            + " AND NOT " + has('behavior', 'GT other'),
            "CASE WHEN followed OR NOT is_end THEN nt END",
            "followed", "check_flag", "ck IS NULL"),
    "burr": family_sql(
        "burr", 'Burr/BH renn', "behavior IS NOT NULL AND (" + has('behavior', 'Burr/BH renn')
            + " OR " + has('previous', 'Burr/BH renn') + ")",
            "CASE WHEN NOT is_end THEN nt END", "followed AND NOT is_end", "check_flag",
            "ck IS NULL", has('behavior', 'Burr/BH renn')),
    "inburr": family_sql(
        "inburr", 'In burr/BH', has('behavior', 'In burr/BH'),
            "CASE WHEN followed AND NOT is_end THEN nt END", "followed AND NOT is_end",
            "CASE WHEN NOT followed AND NOT is_end THEN true ELSE check_flag END", "ck IS NULL"),
    "oov": family_sql(
        "oov", 'Out of view', has('behavior', 'Out of view'),
            "CASE WHEN followed AND NOT is_end THEN nt END", "followed AND NOT is_end",
            f"CASE WHEN NOT followed AND NOT is_end THEN true ELSE {NONE} END", "ck IS NULL"),
}

BY_OTHER_SQL = f"""kept AS (
  SELECT *, lead(behavior) OVER w AS nb, lead(st_sec) OVER w AS nt FROM raw
  WHERE NOT coalesce({hits('behavior', SCAN)} AND {semis('behavior')} = 0, false)
  WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
by_other AS (
  SELECT session_id, seq, nt AS end_sec, nt - st_sec AS duration, modifiers, comments,
         check_flag, {NONE} AS removed
  FROM kept WHERE {has('behavior', 'Dig')} AND NOT {has('behavior', 'End')}
    AND NOT {has('nb', 'End', 'Dig')})"""

DIG_SQL = f"""dig_rows AS (
  SELECT r.*, lead(behavior) OVER w AS nb, lead(r.st_sec) OVER w AS nt,
         lead(r.modifiers) OVER w AS nm
  FROM raw r ANTI JOIN by_other o USING (session_id, seq)
  WHERE {has('behavior', 'Dig')} OR coalesce(behavior = 'End (+Modifiers)', false)
  WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
dig_ends AS (
  SELECT *, {has('behavior', 'Dig; End')} AS is_end,
         coalesce(behavior = 'End (+Modifiers)', false) AS loose,
         (NOT {has('behavior', 'Dig; End')} AND {has('nb', 'Dig; End')})
           OR (NOT {has('behavior', 'Re-Dig; End')} AND {has('nb', 'Re-Dig; End')}) AS followed
  FROM dig_rows),
dig_mods AS (
  SELECT *, CASE WHEN followed AND {has('nm', *SIZED)} THEN nm
                 WHEN followed AND NOT loose THEN 'success' ELSE modifiers END AS mods,
    CASE WHEN NOT followed AND NOT is_end AND NOT loose THEN st_sec + 1
         WHEN followed AND NOT loose THEN nt END AS end_sec
  FROM dig_ends),
dig_named AS (
  SELECT *, coalesce(CASE WHEN is_end THEN {one_size('d.', 'mods', True)} END, behavior) AS named,
         CASE WHEN is_end AND {semis('mods')} > 1 THEN true END AS several
  FROM dig_mods),
dig_flagged AS (
  SELECT *, CASE WHEN {has('named', 'Dig; End')} AND named NOT IN
       ('Dig; End (+Modifiers)', 'Re-Dig; End (+Modifiers)',
        'Other vig.; Dig; End (+Modifiers)', 'Other vig.; Re-Dig; End (+Modifiers)')
     THEN true ELSE check_flag END AS ck
  FROM dig_named),
dig_gone AS (
  SELECT *, CASE WHEN ck IS NULL AND named IN ('Dig; End (+Modifiers)', 'Re-Dig; End (+Modifiers)')
                  AND NOT {has('mods', *SIZED)} THEN true END AS removed
  FROM dig_flagged),
dig AS (
  SELECT session_id, seq, end_sec, end_sec - st_sec AS duration, mods AS modifiers,
         CASE WHEN nc IS NULL THEN comments WHEN nr THEN nc END AS comments,
         ck AS check_flag, removed, named, several
  FROM (SELECT *, lead(comments) OVER w AS nc, lead(removed) OVER w AS nr FROM dig_gone
        WINDOW w AS (PARTITION BY session_id ORDER BY seq)))"""

STAGES_SQL = f"""WITH {RAW_SQL},
{DICTIONARY_SQL},
{','.join(FAMILY_SQL.values())},
{BY_OTHER_SQL},
base0 AS (SELECT *, CAST(NULL AS BIGINT) AS end_sec, CAST(NULL AS BIGINT) AS duration FROM raw),
{lay_sql('base1', 'base0', 'by_other')},
{DIG_SQL},
{lay_sql('base2', 'base1', 'ga')},
{lay_sql('base3', 'base2', 'inburr')},
{lay_sql('base4', 'base3', 'gt')},
{lay_sql('base5', 'base4', 'burr')},
{lay_sql('base6', 'base5', 'oov')},
{lay_sql('base7', 'base6', 'dig', ", p.named, p.several")},
merged AS (SELECT * EXCLUDE (behavior, named, previous, own), coalesce(named, behavior) AS behavior
           FROM base7),
backward AS (
  SELECT *, lag(behavior, 1) OVER w AS b1, lag(behavior, 2) OVER w AS b2,
         lag(behavior, 3) OVER w AS b3
  FROM merged WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
loose AS (
  SELECT * EXCLUDE (b1, b2, b3, check_flag),
    coalesce(behavior = 'End (+Modifiers)', false) AND {has('modifiers', *SIZED)} AS sized,
    {has('b1', 'Dig; End')} OR ({hits('b1', SCAN)} AND {has('b2', 'Dig; End')})
      OR ({hits('b1', SCAN)} AND {hits('b2', SCAN)} AND {has('b3', 'Dig; End')}) AS near,
    CASE WHEN behavior = 'End (+Modifiers)' AND NOT {has('modifiers', *SIZED)} THEN true
         ELSE check_flag END AS check_flag
  FROM backward),
doubled AS (
  SELECT * EXCLUDE (behavior, several), 0 AS marker_rank,
    coalesce(CASE WHEN near THEN {one_size('d.', 'modifiers', False)}
                  ELSE {one_size('fa.', 'modifiers', False)} END, behavior) AS behavior,
    CASE WHEN {semis('modifiers')} > 1 THEN true ELSE several END AS several
  FROM loose WHERE sized
  UNION ALL BY NAME
  SELECT *, 1 AS marker_rank FROM loose),
tiny AS (
  SELECT * EXCLUDE (check_flag), only_tiny, CASE WHEN only_tiny THEN true ELSE check_flag END AS check_flag
  FROM (SELECT *, coalesce({has('modifiers', 'Tiny')}
               AND NOT {has('modifiers', 'Small', 'Medium', 'Large')}
               AND {semis('modifiers')} > 1, false) AS only_tiny FROM doubled)),
sizes AS (
  SELECT *, list_filter([CASE WHEN {has('modifiers', 'Small')} THEN 'Small' END,
                         CASE WHEN {has('modifiers', 'Medium')} THEN 'Medium' END,
                         CASE WHEN {has('modifiers', 'Large')} THEN 'Large' END,
                         CASE WHEN {has('modifiers', *FEW)} THEN 'TinyFew' END,
                         CASE WHEN {has('modifiers', 'Tiny; >5')} THEN 'TinyMany' END],
                        lambda x: x IS NOT NULL) AS found
  FROM tiny WHERE several AND check_flag IS NULL),
size_pieces AS (
  SELECT * EXCLUDE (found), unnest(CASE WHEN len(found) = 0 THEN [''] ELSE found END) AS piece,
         generate_subscripts(CASE WHEN len(found) = 0 THEN [''] ELSE found END, 1) - 1 AS size_pos
  FROM sizes),
sized AS (
  SELECT * EXCLUDE (piece, behavior, modifiers), piece AS modifiers, 0 AS size_rank,
    CASE piece WHEN 'Small' THEN 'd.small' WHEN 'Medium' THEN 'd.medium' WHEN 'Large' THEN 'd.large'
               WHEN 'TinyFew' THEN 'd.tiny.few' WHEN 'TinyMany' THEN 'd.tiny.many'
               ELSE behavior END AS behavior
  FROM size_pieces
  UNION ALL BY NAME
  SELECT *, 0 AS size_pos, 1 AS size_rank FROM tiny WHERE NOT only_tiny AND several IS NULL),
played AS (SELECT * EXCLUDE (play), {direction_sql('play', bare_direction('play'))} AS play FROM sized),
directed AS (
  SELECT * EXCLUDE (agg_sub, olfactory, play), {direction_sql('agg_sub', 'play')} AS agg_sub,
         {direction_sql('olfactory', 'play')} AS olfactory,
         replace(replace(play, 'Wrestle; Bottom', 'Wrestle Bottom'), 'Wrestle; Top', 'Wrestle Top')
           AS play
  FROM played),
lists AS (
  SELECT *, coalesce(string_split(agg_sub, ';'), [NULL]) AS la,
         coalesce(string_split(play, ';'), [NULL]) AS lp,
         coalesce(string_split(olfactory, ';'), [NULL]) AS lo FROM directed),
spread AS (
  SELECT *, greatest(len(la), len(lp), len(lo)) AS longest FROM lists),
pieces AS (
  SELECT * EXCLUDE (agg_sub, play, olfactory), place - 1 AS piece_pos,
         la[CASE WHEN len(la) = 1 THEN 1 ELSE place END] AS agg_sub,
         lp[CASE WHEN len(lp) = 1 THEN 1 ELSE place END] AS play,
         lo[CASE WHEN len(lo) = 1 THEN 1 ELSE place END] AS olfactory
  FROM (SELECT *, unnest(range(1, longest + 1)) AS place FROM spread)),
trimmed AS (
  SELECT session_id, seq, date, st_sec, end_sec, duration, check_flag, focal_no,
    {', '.join(f"trim({c}, ' ' || chr(9)) AS {c}" for c in (
        'agg_sub', 'play', 'olfactory', 'behavior', 'modifiers', 'comments', 'partner',
        'focal_individual', 'pup_care', 'kmp_id', 'location', 'observer', 'groups',
        'life_history', 'time_spent_running', 'time_2', 'sex'))},
    trim(month(date) || '.' || focal_no || '.' || coalesce(kmp_id, 'NA'), ' ' || chr(9)) AS focal_id,
    size_rank, marker_rank, size_pos, piece_pos
  FROM pieces),
outcomes AS (
  SELECT * EXCLUDE (agg_sub, pa),
    CASE WHEN agg_sub IN ('Lose', 'Win', 'Unclear winner') AND {has('pa', 'Fcomp')}
         THEN pa || ' ' || agg_sub ELSE agg_sub END AS agg_sub
  FROM (SELECT *, lag(agg_sub) OVER (PARTITION BY session_id
          ORDER BY seq, size_rank, marker_rank, size_pos, piece_pos) AS pa FROM trimmed)),
listed AS (
  SELECT *, string_split(concat_ws('; ', agg_sub, play, olfactory), '; ') AS tags FROM outcomes),
tagged AS (
  SELECT * EXCLUDE (tags), unnest(tags) AS ob, generate_subscripts(tags, 1) - 1 AS tag_pos
  FROM listed),
stacked AS (
  SELECT * EXCLUDE (behavior), ob AS behavior, 0 AS tag_rank FROM tagged
  WHERE ob <> '' AND behavior NOT IN ('Aggr./Sub.', 'Play', 'Olfactory')
  UNION ALL BY NAME
  SELECT * EXCLUDE (behavior), 1 AS tag_rank,
    CASE WHEN behavior IN ('Aggr./Sub.', 'Play', 'Olfactory') THEN ob ELSE behavior END AS behavior
  FROM tagged),
parts AS (
  SELECT *, CASE WHEN {hits('behavior', '^Approach|^Receive approach')} AND {has('behavior', ';')}
                 THEN string_split(behavior, ';') ELSE [behavior] END AS words FROM stacked),
split AS (
  SELECT * EXCLUDE (words, behavior, ob), trim(ob, ' ' || chr(9)) AS ob,
         trim(unnest(words), ' ' || chr(9)) AS behavior,
         generate_subscripts(words, 1) - 1 AS approach_pos FROM parts),
relabelled AS (
  SELECT s.* EXCLUDE (behavior),
         CASE WHEN e.key IS NOT NULL THEN e.replacement ELSE s.behavior END AS behavior
  FROM split s LEFT JOIN entries e ON e.key = lower(s.behavior)),
shared AS (
  SELECT *, {hits('partner', 'Receive|Recieve')} AND {hits('partner', 'Reciprocate|Initiate')}
            AND NOT {hits('behavior', '^Approach|^Receive approach')} AND ob = '' AS mutual
  FROM relabelled),
own_side AS (
  SELECT * EXCLUDE (partner),
         CASE WHEN mutual THEN regexp_replace(partner, 'Receive;|Recieve;', '') END AS partner
  FROM shared),
mirrored AS (
  SELECT * EXCLUDE (partner, behavior), 0 AS mirror_rank,
    trim(regexp_replace(regexp_replace(partner, 'Reciprocate', 'Receive'), 'Initiate', 'Receive'),
         ' ' || chr(9)) AS partner,
    CASE WHEN regexp_matches(trim(behavior, ' ' || chr(9)), '^i.')
         THEN 'r.' || substr(trim(behavior, ' ' || chr(9)), 3) END AS behavior
  FROM own_side WHERE mutual
  UNION ALL BY NAME
  SELECT *, 1 AS mirror_rank FROM own_side),
clocked AS (
  SELECT *, {', '.join(
      f"CASE WHEN {c} < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d', abs({c}) // 3600, "
      f"abs({c}) // 60 % 60, abs({c}) % 60) AS {n}"
      for c, n in (('st_sec', 'st_time'), ('end_sec', 'end_time'), ('duration', 'duration_time')))}
  FROM mirrored)"""

OUTPUT_SQL = """SELECT session_id, seq, focal_id, location, strftime(date, '%m/%d/%Y') AS date_text,
  st_time, end_time, duration_time AS duration, CAST(duration AS BIGINT) AS s_duration,
  observer, groups, kmp_id, focal_individual, behavior, partner, agg_sub, olfactory, play,
  pup_care, modifiers, life_history, time_spent_running, time_2, sex, comments, check_flag AS "check"
FROM clocked"""

ORDER = ", ".join(ROW_ORDER)


def flagship(spark, sf_dir, place=IN_TURN, **options):
    log, long = scripted_log(spark, sf_dir, place)
    return build(log, dictionary(spark), long=long, **options), long


def _all_headings(events):
    """All 24 headings and the position of the raw row."""
    return events.withColumn("seq", F.col("row_order")["seq"]).drop("row_order")


WHOLE_SQL = STAGES_SQL + "\n" + OUTPUT_SQL


@query(WHOLE_SQL)
def event_table(spark, sf_dir):
    """The whole table: every rule, in the order in which the protocol applies them."""
    return _all_headings(flagship(spark, sf_dir)[0])


@query(scattered(WHOLE_SQL))
def event_table_scattered(spark, sf_dir):
    """The same over rows whose neighbours vary."""
    return _all_headings(flagship(spark, sf_dir, SCATTERED)[0])


# Sessions that are cut, and the blocks they are cut into.
LONG_ROWS, BLOCK = 66, 7
LOG_BUCKETS = 8


@query(scattered(WHOLE_SQL))
def event_table_blocked(spark, sf_dir):
    """The same with long sessions worked block by block."""
    log, long = scripted_log(spark, sf_dir, SCATTERED, LONG_ROWS)
    return _all_headings(build(log, dictionary(spark), long=long, block_rows=BLOCK))


@query(scattered(WHOLE_SQL))
def event_table_laid_out(spark, sf_dir):
    """The same from a log that lies bucketed by session: no exchange of the log."""
    log, long = scripted_log(spark, sf_dir, SCATTERED)
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    write_log(log, path, buckets=LOG_BUCKETS)
    return _all_headings(build(read_log(spark, path), dictionary(spark), long=long))


_LATER = {"mirrored": "mirror_rank = 0", "approach": "approach_pos > 0", "tag_label": "tag_rank = 0",
          "tag": "tag_pos > 0", "piece": "piece_pos > 0", "size": "size_pos > 0",
          "marker": "marker_rank = 0"}
_CAUSE = ("CASE " + " ".join(f"WHEN {test} THEN '{step}'" for step, test in _LATER.items())
          + " ELSE 'original' END")

# What each step removed or added, from the rows before and after it.
COUNTS_SQL = STAGES_SQL + f"""
SELECT 'rows_in' AS measure, (SELECT count(*) FROM log) AS n
UNION ALL SELECT 'ended', (SELECT count(*) FROM log) - (SELECT count(*) FROM merged)
UNION ALL SELECT 'unresolved', (SELECT count(*) FROM tiny WHERE marker_rank = 1
  AND (only_tiny OR (coalesce(several, false) AND check_flag IS NOT NULL)))
UNION ALL SELECT 'rows_out', (SELECT count(*) FROM clocked)
UNION ALL SELECT 'flagged', (SELECT count(*) FROM clocked WHERE check_flag)
UNION ALL SELECT step, count(cause) FROM (VALUES ('original'), {', '.join(f"('{s}')" for s in _LATER)}) AS s(step)
  LEFT JOIN (SELECT {_CAUSE} AS cause FROM clocked) ON cause = step GROUP BY step"""


@query(scattered(COUNTS_SQL))
def row_accounting(spark, sf_dir):
    """Rows removed, kept, added by each step and flagged, counted while the table is
    written, long sessions cut; the query fails if they do not add up."""
    log, long = scripted_log(spark, sf_dir, SCATTERED, LONG_ROWS)
    counts = RowCounts()
    settle(build(log, dictionary(spark), long=long, block_rows=BLOCK, counts=counts))
    return counts.frame(spark)


ORDERED_SQL = STAGES_SQL + f"""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY {ORDER}) AS row_no,
  seq, behavior, partner, modifiers, s FROM (SELECT *, CAST(duration AS BIGINT) AS s FROM clocked)"""


@query(ORDERED_SQL)
def stable_order(spark, sf_dir):
    """Copies before originals, pieces in place: the order as a dense number."""
    events, long = flagship(spark, sf_dir)
    ranked = events.select("session_id", "row_order.*", "behavior", "partner", "modifiers",
                           F.col("s_duration").alias("s"))
    done = per_session(ranked, lambda df, line: row_position(df, line, "row_no"),
                       order=ROW_ORDER, long=long)
    return done.select("session_id", "row_no", "seq", "behavior", "partner", "modifiers", "s")


def _numbered_back(back):
    """What a reader of the sink does to restore the order."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("row_order")).cast("bigint")
    return back.select(
        "session_id", place.alias("row_no"), F.col("row_order.seq").alias("seq"),
        F.col("Behavior").alias("behavior"), F.col("`Partner(s)`").alias("partner"),
        F.col("Modifiers").alias("modifiers"), F.col("`S.Duration`").alias("s"))


@query(ORDERED_SQL)
def sink_order(spark, sf_dir):
    """Long sessions cut, written as the job writes them in shared directories, read
    and put in order."""
    log, long = scripted_log(spark, sf_dir, limit=LONG_ROWS)
    events = report(build(log, dictionary(spark), long=long, block_rows=BLOCK), keep_order=True)
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    write_sessions(events, path, ranged=long is not None, buckets=8)
    return _numbered_back(spark.read.schema(events.schema).parquet(path))


@query(ORDERED_SQL)
def sink_single_table(spark, sf_dir):
    """The report as one sorted table, read and put in order."""
    events = report(flagship(spark, sf_dir)[0], keep_order=True)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    write_table(events, path)
    return _numbered_back(spark.read.schema(events.schema).parquet(path))


# -- repairs: the statement with one branch switched --------------------------------

def _switched(sql: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"not in the statement: {old}")
        sql = sql.replace(old, new)
    return sql


_TRIMMED = "trim(behavior, ' ' || chr(9))"
_RESIDUE = """coalesce(regexp_matches(regexp_replace(modifiers, 'Small|Medium|Large|Tiny', '', 'g'),
  '[a-zA-Z]'), false)"""

REPAIRED_SQL = {
    # The first row of a run is paired, too.
    "gt_first": [(FAMILY_SQL["gt"], family_sql(
        "gt", "GT", f"behavior IS NOT NULL AND NOT {has('behavior', 'GT other')} AND ("
        + has("behavior", "GT") + " OR " + has("previous", "GT") + ")",
        "CASE WHEN followed OR NOT is_end THEN nt END", "followed", "check_flag", "ck IS NULL",
        f"{has('behavior', 'GT')} AND NOT {has('behavior', 'GT other')}"))],
    # Out of view keeps an earlier review flag.
    "oov_check": [(f"THEN true ELSE {NONE} END AS ck", "THEN true ELSE check_flag END AS ck")],
    # Only dig rows and loose markers end the look-ahead of a dig.
    "dig_lookahead": [(f"AND NOT {has('nb', 'End', 'Dig')})",
                       f"AND NOT ({has('nb', 'Dig')} OR coalesce(starts_with(nb, 'End (+Modifiers)'), false)))")],
    # A loose marker keeps the size it names.
    "marker_own_size": [(f"CASE WHEN followed AND {has('nm', *SIZED)} THEN nm",
                         f"CASE WHEN loose AND {has('modifiers', *SIZED)} THEN modifiers "
                         f"WHEN followed AND {has('nm', *SIZED)} THEN nm")],
    # Loose markers look back at the labels as written.
    "near_original": [("coalesce(named, behavior) AS behavior\n", "coalesce(named, behavior) AS behavior, "
                       "behavior AS written\n"),
                      ("SELECT *, lag(behavior, 1) OVER w AS b1, lag(behavior, 2) OVER w AS b2,\n"
                       "         lag(behavior, 3) OVER w AS b3\n  FROM merged",
                       "SELECT * EXCLUDE (written), lag(written, 1) OVER w AS b1, lag(written, 2) OVER w AS b2,\n"
                       "         lag(written, 3) OVER w AS b3\n  FROM merged")],
    # Letters beside the sizes of a list put it under review.
    "residual_text": [("CASE WHEN only_tiny THEN true ELSE check_flag END AS check_flag",
                       f"CASE WHEN only_tiny OR (coalesce(several, false) AND {_RESIDUE}) "
                       "THEN true ELSE check_flag END AS check_flag")],
    # Rows under review stay.
    "keep_flagged": [("FROM tiny WHERE NOT only_tiny AND several IS NULL)",
                      "FROM tiny WHERE several IS NULL OR check_flag IS NOT NULL)")],
    # Sizes of a loose marker away from digs are found, not dug.
    "fa_multi": [("CASE piece WHEN 'Small' THEN 'd.small' WHEN 'Medium' THEN 'd.medium' "
                  "WHEN 'Large' THEN 'd.large'\n               WHEN 'TinyFew' THEN 'd.tiny.few' "
                  "WHEN 'TinyMany' THEN 'd.tiny.many'\n               ELSE behavior END AS behavior",
                  "CASE WHEN piece = '' THEN behavior ELSE CASE WHEN sized AND NOT near THEN 'fa.' ELSE 'd.' END\n"
                  "    || CASE piece WHEN 'TinyFew' THEN 'tiny.few' WHEN 'TinyMany' THEN 'tiny.many' "
                  "ELSE lower(piece) END END AS behavior")],
    # A tag text is spread by its own direction.
    "own_guard": [(direction_sql("agg_sub", "play"), direction_sql("agg_sub", bare_direction("agg_sub"))),
                  (direction_sql("olfactory", "play"),
                   direction_sql("olfactory", bare_direction("olfactory")))],
    # Originals are not repeated for each of several tags.
    "dedup_original": [("ELSE behavior END AS behavior\n  FROM tagged),",
                        "ELSE behavior END AS behavior\n  FROM tagged\n  WHERE NOT (coalesce(behavior "
                        "NOT IN ('Aggr./Sub.', 'Play', 'Olfactory'), false) AND (piece_pos > 0 OR tag_pos > 0))),")],
    # Partners of rows that are not split stay.
    "keep_partner": [("CASE WHEN mutual THEN regexp_replace(partner, 'Receive;|Recieve;', '') END AS partner",
                      "CASE WHEN mutual THEN regexp_replace(partner, 'Receive;|Recieve;', '') "
                      "ELSE partner END AS partner")],
    # Only the prefix itself flips, other labels stay.
    "mirror_literal": [(f"CASE WHEN regexp_matches({_TRIMMED}, '^i.')\n         THEN 'r.' || substr({_TRIMMED}, 3) END",
                        f"CASE WHEN starts_with({_TRIMMED}, 'i.')\n         THEN 'r.' || substr({_TRIMMED}, 3) "
                        f"ELSE {_TRIMMED} END")],
    # The place is filled down like the id.
    "fill_location": [("CASE WHEN " + has("focal_individual", "Burrow") + " AND ",
                       "last_value(CASE WHEN " + has("focal_individual", "Burrow") + " AND "),
                      ("THEN 'Forage' END AS location",
                       "THEN 'Forage' END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS location")],
    # A state that ends after midnight.
    "rollover": [("  FROM mirrored)", "  FROM (SELECT * REPLACE (CASE WHEN duration < 0 THEN duration + 86400 "
                  "ELSE duration END AS duration) FROM mirrored))")],
}


def _register_repair(name: str, *repairs: str) -> None:
    changes = [c for r in repairs for c in REPAIRED_SQL[r]]

    @query(_switched(WHOLE_SQL, *changes), name=name)
    def repaired(spark, sf_dir):
        return _all_headings(flagship(spark, sf_dir, repair=set(repairs))[0])


for _name in REPAIRED_SQL:
    _register_repair(f"repair_{_name}", _name)
_register_repair("event_table_repaired", *REPAIRED_SQL)
