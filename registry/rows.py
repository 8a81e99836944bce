"""Queries over joins, look-behind, row multiplication and union."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace import functions as fx
from fieldtrace import operators as op
from fieldtrace.operators import rows as ops
from fieldtrace.vocabulary import CATEGORIES

from .base import has, hits, query, semis, table
from .script import DICTIONARY_SQL, LOG_SQL, dictionary, scripted_log
from .table import FEW, SCAN, SIZED, one_size


def _log(spark, sf_dir, *cols):
    return scripted_log(spark, sf_dir)[0].select("session_id", "seq", *cols)


OVERLAY_SQL = """SELECT d.doc_id, d.source, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.lang)
  AS lang, coalesce(l.quality * 10, d.n_chars) AS n_chars
FROM documents d LEFT JOIN labels l ON l.doc_id IS NOT DISTINCT FROM d.doc_id"""


@query(OVERLAY_SQL + " WHERE l.toxic IS NULL OR l.toxic <> 1")
def overlay(spark, sf_dir):
    """Labels laid over documents; toxic ones remove the document."""
    base = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    patch = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.lit("good")).alias("lang"),
        (F.col("quality") * 10).cast("bigint").alias("n_chars"),
        F.when(F.col("toxic") == 1, F.lit(True)).alias("removed"))
    return op.overlay(base, patch, ["doc_id"], ["lang", "n_chars"], drop_flag="removed")


@query("""WITH last AS (
  SELECT user_id, event_type, value, row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events)
SELECT c_custkey, coalesce(l.event_type, c_mktsegment) AS c_mktsegment,
  coalesce(l.value, c_acctbal) AS c_acctbal
FROM customer LEFT JOIN last l ON l.user_id = c_custkey AND nth = 1
WHERE coalesce(l.event_type <> 'error', true)""")
def overlay_repeated_keys(spark, sf_dir):
    """The last event of each user laid over customers; the patch repeats its keys."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    patch = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"),
        F.col("value").alias("c_acctbal"), "ts", "event_id",
        F.when(F.col("event_type") == "error", F.lit(True)).alias("gone"))
    return op.overlay(base, patch, ["c_custkey"], ["c_mktsegment", "c_acctbal"], "gone",
                      prefer=["ts", "event_id"])


@query(f"""WITH {LOG_SQL} SELECT session_id, seq,
  coalesce(play, agg_sub, olfactory, behavior) AS first, coalesce(pup_care, comments) AS note
FROM log""")
def coalesce_patch(spark, sf_dir):
    rows = _log(spark, sf_dir, "behavior", "play", "agg_sub", "olfactory", "pup_care", "comments")
    c = {n: F.col(n) for n in rows.columns}
    return rows.select(
        "session_id", "seq",
        op.coalesce_patch(c["behavior"], c["play"], c["agg_sub"], c["olfactory"]).alias("first"),
        op.coalesce_patch(c["comments"], c["pup_care"]).alias("note"))


@query(f"""WITH {LOG_SQL}, {DICTIONARY_SQL}
SELECT l.session_id, l.seq,
  CASE WHEN e.key IS NOT NULL THEN e.replacement ELSE l.behavior END AS behavior
FROM log l LEFT JOIN entries e ON e.key = lower(l.behavior)""")
def dictionary_relabel(spark, sf_dir):
    return op.relabel(_log(spark, sf_dir, "behavior"), dictionary(spark))


@query("""WITH entries AS (
  SELECT key, kind FROM (SELECT lower(p_name) AS key, p_type AS kind,
    row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS place FROM part)
  WHERE place = 1)
SELECT p_partkey, p_brand, CASE WHEN e.key IS NOT NULL THEN e.kind ELSE p.p_name END AS label
FROM part p LEFT JOIN entries e ON e.key = lower(p.p_name)""")
def dictionary_relabel_by_shuffle(spark, sf_dir):
    """The way taken when a dictionary is too large to broadcast."""
    part = table(spark, sf_dir, "part")
    entries = part.select(
        F.col("p_name").alias("behavior"), F.col("p_type").alias("replacement"),
        F.col("p_partkey").alias("dict_seq"))
    rows = part.select("p_partkey", "p_brand", F.col("p_name").alias("label"))
    return op.relabel(rows, entries, "label", small=False, hot_rows=20)


NEAR_SQL = f"""near AS (
  SELECT *, {has('b1', 'Dig; End')} OR ({hits('b1', SCAN)} AND {has('b2', 'Dig; End')})
      OR ({hits('b1', SCAN)} AND {hits('b2', SCAN)} AND {has('b3', 'Dig; End')}) AS near,
    coalesce(behavior = 'End (+Modifiers)', false) AND {has('modifiers', *SIZED)} AS sized
  FROM (SELECT *, lag(behavior, 1) OVER w AS b1, lag(behavior, 2) OVER w AS b2,
          lag(behavior, 3) OVER w AS b3 FROM log
        WINDOW w AS (PARTITION BY session_id ORDER BY seq)))"""


def _near(spark, sf_dir):
    log, long = scripted_log(spark, sf_dir)
    rows = log.select("session_id", "seq", "behavior", "modifiers")
    return op.per_session(
        rows, lambda df, line: op.near_marker(df, line, F.col("behavior")), long=long)


@query(f"""WITH {LOG_SQL}, {NEAR_SQL}
SELECT session_id, seq, sized AND near AS near, sized AND NOT near AS far,
  coalesce(behavior = 'End (+Modifiers)', false) AND NOT sized AS unsized FROM near""")
def near_marker(spark, sf_dir):
    sized, loose = ops.is_sized_loose(), ops.is_loose("behavior")
    return _near(spark, sf_dir).select(
        "session_id", "seq", (sized & F.col("near")).alias("near"),
        (sized & ~F.col("near")).alias("far"), (loose & ~sized).alias("unsized"))


@query(f"""WITH {LOG_SQL}, {NEAR_SQL}
SELECT session_id, seq, modifiers, 0 AS marker_rank, coalesce(
  CASE WHEN near THEN {one_size('d.', 'modifiers', False)}
       ELSE {one_size('fa.', 'modifiers', False)} END, behavior) AS behavior FROM near WHERE sized
UNION ALL SELECT session_id, seq, modifiers, 1, behavior FROM near""")
def duplicate_label(spark, sf_dir):
    """Sized loose markers twice: under their size label, and as they are."""
    label = F.when(F.col("near"), fx.size_label("modifiers", "d.", lone_tiny=False)).otherwise(
        fx.size_label("modifiers", "fa.", lone_tiny=False))
    return op.duplicate_where(
        _near(spark, sf_dir), ops.is_sized_loose(), "marker_rank",
        {"behavior": F.coalesce(label, F.col("behavior"))}).drop("near")


@query(f"""WITH {LOG_SQL}, tagged AS (
  SELECT session_id, seq, behavior, unnest(string_split(concat_ws('; ', agg_sub, play, olfactory), '; ')) AS ob
  FROM log)
SELECT session_id, seq, ob AS behavior, ob, 0 AS tag_rank FROM tagged
WHERE ob <> '' AND behavior NOT IN ('Aggr./Sub.', 'Play', 'Olfactory')
UNION ALL SELECT session_id, seq, CASE WHEN behavior IN ('Aggr./Sub.', 'Play', 'Olfactory')
  THEN ob ELSE behavior END, ob, 1 FROM tagged""")
def duplicate_tagged(spark, sf_dir):
    rows = _log(spark, sf_dir, "behavior", fx.merge_tags(["agg_sub", "play", "olfactory"]).alias("ob"))
    rows = op.explode_tokens(rows, "ob", "; ", "ob", "tag_pos").drop("tag_pos")
    category = F.col("behavior").isin(*CATEGORIES)
    rows = op.duplicate_where(rows, (F.col("ob") != "") & ~category, "tag_rank",
                              {"behavior": F.col("ob")})
    return rows.withColumn("behavior", F.when(category, F.col("ob")).otherwise(F.col("behavior")))


@query(f"""WITH {LOG_SQL}, shared AS (
  SELECT session_id, seq, behavior, {hits('partner', 'Receive|Recieve')}
      AND {hits('partner', 'Reciprocate|Initiate')}
      AND NOT {hits('behavior', '^Approach|^Receive approach')}
      AND concat_ws('; ', agg_sub, play, olfactory) = '' AS mutual,
    regexp_replace(partner, 'Receive;|Recieve;', '') AS rest FROM log)
SELECT session_id, seq, 1 AS mirror_rank, behavior, CASE WHEN mutual THEN rest END AS partner
FROM shared
UNION ALL SELECT session_id, seq, 0,
  CASE WHEN regexp_matches(trim(behavior), '^i.') THEN 'r.' || substr(trim(behavior), 3) END,
  trim(regexp_replace(regexp_replace(rest, 'Reciprocate', 'Receive'), 'Initiate', 'Receive'))
FROM shared WHERE mutual""")
def mirror_partner(spark, sf_dir):
    rows = _log(spark, sf_dir, "behavior", "partner",
                fx.merge_tags(["agg_sub", "play", "olfactory"]).alias("ob"))
    return op.mirror_partner(rows).drop("ob")


@query("""SELECT doc_id, unnest(string_split(text, '. ')) AS token,
  CAST(generate_subscripts(string_split(text, '. '), 1) - 1 AS INTEGER) AS pos FROM documents""")
def explode_tokens(spark, sf_dir):
    """Whole texts into sentences, one row each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.explode_tokens(rows, "text", r"\. ", "token", "pos").drop("text")


def _lists_sql(select):
    return f"""WITH {LOG_SQL}, split AS (
  SELECT *, coalesce(string_split(agg_sub, ';'), [NULL]) AS la,
         coalesce(string_split(play, ';'), [NULL]) AS lp,
         coalesce(string_split(olfactory, ';'), [NULL]) AS lo FROM log),
sizes AS (SELECT *, greatest(len(la), len(lp), len(lo)) AS most FROM split),
lists AS (
  SELECT *, (len(la) NOT IN (1, most)) OR (len(lp) NOT IN (1, most)) OR (len(lo) NOT IN (1, most)) AS uneven
  FROM sizes),
pieces AS (
  SELECT session_id, seq, CAST(place - 1 AS INTEGER) AS piece_pos,
         CASE WHEN uneven THEN true WHEN pup_care IS NOT NULL THEN true END AS "check",
         CASE WHEN uneven THEN agg_sub ELSE la[CASE WHEN len(la) = 1 THEN 1 ELSE place END] END AS agg_sub,
         CASE WHEN uneven THEN play ELSE lp[CASE WHEN len(lp) = 1 THEN 1 ELSE place END] END AS play,
         CASE WHEN uneven THEN olfactory ELSE lo[CASE WHEN len(lo) = 1 THEN 1 ELSE place END] END AS olfactory
  FROM (SELECT *, unnest(range(1, CASE WHEN uneven THEN 2 ELSE most + 1 END)) AS place FROM lists))
{select}"""


TAGS = ("agg_sub", "play", "olfactory")


def _pieces(df):
    """All rows; lists of different length stay whole and are flagged."""
    return op.zip_explode(df, TAGS, ";", on_mismatch="flag")


def _tag_rows(log):
    return log.select("session_id", "seq", *TAGS,
                      fx.review_flag("pup_care", F.lit(None).cast("boolean")).alias("check"))


@query(_lists_sql("SELECT * FROM pieces"))
def zip_explode(spark, sf_dir):
    return _pieces(_tag_rows(scripted_log(spark, sf_dir)[0]))


@query(_lists_sql("""SELECT session_id, seq, piece_pos, play, olfactory, "check",
  CASE WHEN trim(agg_sub) IN ('Lose', 'Win', 'Unclear winner') AND coalesce(contains(pa, 'Fcomp'), false)
       THEN trim(pa) || ' ' || trim(agg_sub) ELSE trim(agg_sub) END AS agg_sub
FROM (SELECT *, lag(agg_sub) OVER (PARTITION BY session_id ORDER BY seq, piece_pos) AS pa
      FROM (SELECT * EXCLUDE (play, olfactory), trim(play) AS play, trim(olfactory) AS olfactory
            FROM pieces))"""))
def attach_outcome(spark, sf_dir):
    """Outcomes take the competition tag before them, also across rows."""
    log, long = scripted_log(spark, sf_dir)

    def work(df, line):
        return op.attach_outcome(op.trim_all(_pieces(df)), line.ordered_by("seq", "piece_pos"))

    return op.per_session(_tag_rows(log), work, long=long)


@query(f"""WITH {LOG_SQL}, named AS (
  SELECT *, list_filter([CASE WHEN {has('modifiers', 'Small')} THEN 'Small' END,
                         CASE WHEN {has('modifiers', 'Medium')} THEN 'Medium' END,
                         CASE WHEN {has('modifiers', 'Large')} THEN 'Large' END,
                         CASE WHEN {has('modifiers', *FEW)} THEN 'TinyFew' END,
                         CASE WHEN {has('modifiers', 'Tiny; >5')} THEN 'TinyMany' END],
                        lambda x: x IS NOT NULL) AS found FROM log),
pieces AS (
  SELECT *, unnest(CASE WHEN len(found) = 0 THEN [''] ELSE found END) AS piece,
    generate_subscripts(CASE WHEN len(found) = 0 THEN [''] ELSE found END, 1) - 1 AS place
  FROM named WHERE {semis('modifiers')} > 1)
SELECT session_id, seq, piece AS modifiers, 0 AS size_rank, CAST(place AS INTEGER) AS size_pos,
  CASE piece WHEN 'TinyFew' THEN 'd.tiny.few' WHEN 'TinyMany' THEN 'd.tiny.many' WHEN '' THEN behavior
    ELSE 'd.' || lower(piece) END AS behavior FROM pieces
UNION ALL SELECT session_id, seq, modifiers, 1, 0, behavior FROM log
WHERE modifiers IS NULL OR {semis('modifiers')} <= 1""")
def explode_sizes(spark, sf_dir):
    rows = _log(spark, sf_dir, "behavior", "modifiers")
    return op.explode_sizes(rows, fx.count_pattern("modifiers", ";") > 1)


TWO_SQL = f"""{has('modifiers', 'Tiny')} AND NOT {has('modifiers', *SIZED[1:])}
  AND coalesce({semis('modifiers')} > 1, false)"""


@query(f"WITH {LOG_SQL} SELECT session_id, seq, {TWO_SQL} AS flagged FROM log")
def flag_two_small(spark, sf_dir):
    return _log(spark, sf_dir, "modifiers").select(
        "session_id", "seq", ops.two_small().alias("flagged"))


@query(f"""WITH {LOG_SQL} SELECT session_id, seq, coalesce(regexp_matches(
  regexp_replace(modifiers, 'Small|Medium|Large|Tiny', '', 'g'), '[a-zA-Z]'), false) AS residue
FROM log""")
def residual_text(spark, sf_dir):
    return _log(spark, sf_dir, "modifiers").select(
        "session_id", "seq", ops.residual_text().alias("residue"))


@query(f"""WITH {LOG_SQL}, parts AS (
  SELECT session_id, seq, CASE WHEN {hits('behavior', '^Approach|^Receive approach')}
      AND {has('behavior', ';')} THEN string_split(behavior, ';') ELSE [behavior] END AS words FROM log)
SELECT session_id, seq, unnest(words) AS behavior,
  CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS approach_pos FROM parts""")
def explode_conditional(spark, sf_dir):
    return op.explode_conditional(_log(spark, sf_dir, "behavior"), ops.splits_approach(), ";")


@query(f"""WITH {LOG_SQL}
SELECT session_id, seq, behavior, partner, 0 AS copy_rank FROM log WHERE partner IS NOT NULL
UNION ALL SELECT session_id, seq, behavior, NULL, 1 FROM log""")
def union_ordered(spark, sf_dir):
    """Copies with a partner before originals without that column."""
    log = _log(spark, sf_dir, "behavior", "partner")
    return op.union_ordered(log.where(F.col("partner").isNotNull()), log.drop("partner"),
                            "copy_rank")
