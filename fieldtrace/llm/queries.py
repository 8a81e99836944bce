"""Registered queries: each applies one operator to its whole table.

The operators keep their own outputs; the queries derive the agreed columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bitpacked_tokens, block_anchors, chat_perspectives, covering_simhash, crf_pii,
               factorisation_machine, island_packing, license_diagonals, permutation_index,
               prefix_trie, source_divergence, source_mixing, suffix_decontamination)
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def token_digest(docs: DataFrame) -> DataFrame:
    """Write all documents as token ids and tell what the files hold."""
    manifest = bitpacked_tokens.write_tokens(docs, tokenizer_file())
    return bitpacked_tokens.read_tokens(manifest).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each vector whose id is divisible by 20."""
    found = permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


_WORDS10 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


_CHAT_SQL = f"""WITH t AS (
  SELECT conv_id, coalesce(nullif(role, ''), 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           coalesce(nullif(role, ''), 'unknown'), replace(coalesce(text, ''), '<|', '< |')) AS seq
  FROM conversations),
seats AS (SELECT DISTINCT conv_id, speaker AS seat FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, seat, (seq - 1) // {chat_perspectives.PART_TURNS} AS part, seq, speaker = seat AS own,
         CASE WHEN speaker = seat THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
              ELSE '<|user:' || speaker || '|>' END || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body
  FROM t JOIN seats s ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
p AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, seat, part ORDER BY seq) AS upto
  FROM r)
SELECT conv_id, seat AS speaker, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY seq) AS text,
       coalesce(string_agg(CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT), ','
                ORDER BY seq) FILTER (WHERE own), '') AS mask
FROM p GROUP BY conv_id, seat, part"""


@query(_CHAT_SQL)
def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every perspective, the mask as start-stop pairs."""
    found = chat_perspectives.perspectives(table(spark, sf_dir, "conversations"))
    return found.select(
        F.col("conv").alias("conv_id"), "speaker", "part", "n_turns", "text",
        F.array_join(F.transform("mask", lambda m: F.concat_ws(
            "-", m["start"].cast("string"), m["stop"].cast("string"))), ",").alias("mask"))


def _license_sql() -> str:
    rows = ", ".join(
        f"({n}, string_split('{text}', ' '), '{label}', {exact})" for n, (text, label, exact) in enumerate(
            [(*b, "true") for b in license_diagonals.BASE]
            + [(*t, "false") for t in license_diagonals.TEMPLATES]))
    gap, least, stretch = (license_diagonals.GAP, license_diagonals.LEAST_SHARE,
                           license_diagonals.STRETCH)
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS10} AS w FROM documents),
t(template, w, label, exact) AS (VALUES {rows}),
tp AS (SELECT template, label, exact, len(w) - 1 AS pairs, k - 1 AS tpos, w[k] AS a, w[k + 1] AS b
  FROM t, unnest(range(1, len(w))) AS s(k)),
dp AS (SELECT r, k - 1 AS pos, w[k] AS a, w[k + 1] AS b FROM d, unnest(range(1, len(w))) AS s(k)),
v AS (SELECT r, template, label, exact, pairs, pos - tpos AS diagonal, min(tpos) AS lo, max(tpos) AS hi,
        list(DISTINCT tpos) AS ts
  FROM dp JOIN tp USING (a, b) GROUP BY ALL),
c AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER l > {gap} THEN 1 ELSE 0 END AS cut
  FROM v WINDOW l AS (PARTITION BY r, template ORDER BY diagonal)),
m AS (SELECT *, sum(cut) OVER (PARTITION BY r, template ORDER BY diagonal) AS band FROM c),
s AS (SELECT r, template, band, label, exact, pairs, len(list_distinct(flatten(list(ts)))) AS votes,
        min(diagonal + lo) AS start, max(diagonal + hi) + 2 AS stop
  FROM m GROUP BY r, template, label, exact, pairs, band),
e AS (SELECT *, exact OR stop - start <= {stretch} * (pairs + 1) AS short FROM s
  WHERE CASE WHEN exact THEN votes = pairs ELSE votes >= {least} * pairs END),
ln AS (SELECT m.*, row_number() OVER (PARTITION BY m.r, m.template, m.band ORDER BY diagonal) AS k
  FROM m JOIN e ON e.r = m.r AND e.template = m.template AND e.band = m.band AND NOT e.short),
ru AS (SELECT a.r, a.template, a.band, a.label, a.pairs, a.k AS i, z.k AS j,
         a.pairs - len(list_distinct(flatten(list(z.ts) OVER o))) AS missed,
         min(z.diagonal + z.lo) OVER o AS start, max(z.diagonal + z.hi) OVER o + 2 AS stop
  FROM ln a JOIN ln z ON z.r = a.r AND z.template = a.template AND z.band = a.band AND z.k >= a.k
    AND z.k < a.k + ceil({stretch} * (a.pairs + 1)) + a.pairs + 1
  WINDOW o AS (PARTITION BY a.r, a.template, a.band, a.k ORDER BY z.k)),
be AS (SELECT DISTINCT r, template, band, label, pairs, missed, stop - start AS length, start, stop FROM (
    SELECT *, row_number() OVER (PARTITION BY r, template, band, i ORDER BY missed, j) AS nth FROM ru
    WHERE missed <= (1 - {least}) * pairs AND stop - start <= {stretch} * (pairs + 1)) WHERE nth = 1),
fo AS (SELECT r, template, band, label, pairs, list({{'missed': missed, 'start': start, 'stop': stop}}
         ORDER BY missed, length, start, stop) AS fs FROM be GROUP BY r, template, band, label, pairs),
pick AS (SELECT r, label, pairs, fs, 1 AS k, [fs[1]] AS kept FROM fo
  UNION ALL
  SELECT r, label, pairs, fs, k + 1, CASE WHEN len(list_filter(kept, lambda c:
           fs[k + 1].start < c.stop AND c.start < fs[k + 1].stop)) > 0
         THEN kept ELSE list_append(kept, fs[k + 1]) END
  FROM pick WHERE k < len(fs)),
f AS (SELECT r, label, exact, pairs, votes, start FROM e WHERE short
  UNION ALL
  SELECT r, label, false, pairs, pairs - x.missed, x.start
  FROM (SELECT r, label, pairs, unnest(kept) AS x FROM pick WHERE k = len(fs))),
g AS (SELECT r, count(*) FILTER (WHERE exact) AS n_base, min(start) FILTER (WHERE exact) AS first_word,
        max(start) FILTER (WHERE exact) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(votes / pairs) AS score
  FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (r)"""


@query(_license_sql())
def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and the best share of a template in every document."""
    found = license_diagonals.scan(table(spark, sf_dir, "documents"), each_row=True)
    base = F.filter("places", lambda p: p["base"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(
            places, lambda p: p["label"]))), ",")

    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))
        .alias("score"))


@query()
def op2_bitpacked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


_REPEATS_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT r, doc_id, k, array_to_string(w[k:k + 49], ' ') AS g
  FROM d, unnest(range(1, len(w) - 48)) AS s(k) WHERE len(w) >= 50 AND doc_id IS NOT NULL),
firsts AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT r, unnest(range(k, k + 50)) AS p
  FROM win JOIN firsts USING (g) WHERE doc_id > least),
words AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS s(p)),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


@query(_REPEATS_SQL)
def op4_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = block_anchors.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def learnt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return table(spark, sf_dir, "labels").where(_fold() != 0).select("doc_id", "quality")


@query()
def op6_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = factorisation_machine.train(docs, learnt_labels(spark, sf_dir), meta=("n_chars",))
    scored = docs.select("doc_id", factorisation_machine.score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", (_fold() == 0).alias("held_out"), "score",
        (F.col("score") >= factorisation_machine.THRESHOLD).cast("int").alias("predicted"))


@query()
def op7_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans; the spans come ordered by kind and start."""
    found = table(spark, sf_dir, "documents").select(
        "doc_id", crf_pii.personal_data(F.col("text")).alias("found"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["source"] == "base")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts,
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"))


@query()
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def _mixing_sql() -> str:
    words = r"[^ \t\n\x0B\f\r]+"
    steps = [r"""w AS (
  SELECT doc_id, text, coalesce(nullif(source, ''), 'unknown') AS source,
         coalesce(nullif(lang, ''), 'unknown') AS lang,
         len(regexp_extract_all(coalesce(text, ''), '""" + words + r"""')) AS tokens,
         len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS numbers
  FROM documents)""", f"""d AS MATERIALIZED (
  SELECT doc_id, source, lang, tokens,
         CASE WHEN regexp_matches(text, '{source_mixing.LEGAL}') THEN 'legal'
              WHEN numbers * 20 > tokens THEN 'data'
              WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END AS topic,
         CAST(CAST('0x' || substr(md5('{source_mixing.SEED}:' ||
              coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS u FROM w)""",
        """c0 AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, 1.0::DOUBLE AS weight
  FROM d GROUP BY ALL)"""]
    for margin, power in source_mixing.TEMPER.items():
        steps.append(f"""t_{margin} AS MATERIALIZED (
  SELECT {margin}, share / sum(share) OVER () AS share FROM (
    SELECT {margin}, pow(sum(tokens), {power}) AS share FROM c0 GROUP BY {margin}
    HAVING sum(tokens) > 0))""")
    n = 0
    for _ in range(source_mixing.ROUNDS):
        for margin in source_mixing.MARGINS:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.source, c.lang, c.topic, c.tokens,
         c.weight * CASE WHEN h.have > 0 THEN coalesce(t.share, 0)
           * (SELECT sum(tokens) FROM c0) / h.have ELSE 1 END AS weight
  FROM c{n} c JOIN (SELECT {margin}, sum(tokens * weight) AS have FROM c{n} GROUP BY {margin}) h
    ON h.{margin} = c.{margin} LEFT JOIN t_{margin} t ON t.{margin} = c.{margin})""")
            n += 1
    # The weight from which on a cell is kept whole.  The kept tokens are the least of all
    # sums in which the heaviest cells count whole and the others by weight over scale, so
    # each such sum must reach the least share.
    return f"""WITH {', '.join(steps)}, z AS (
  SELECT {source_mixing.LEAST_KEPT} * sum(tokens) FILTER (WHERE weight > 0) AS least, max(weight) AS most
  FROM c{n} WHERE tokens > 0),
j AS (
  SELECT coalesce(sum(tokens) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(tokens * weight) OVER (h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS part
  FROM c{n} WHERE tokens > 0 AND weight > 0 WINDOW h AS (ORDER BY weight DESC, source, lang, topic)),
k AS (
  SELECT least(most, (SELECT min(part / (least - full_)) FROM j, z WHERE least > full_)) AS scale FROM z),
p AS (
  SELECT source, lang, topic, coalesce(least(weight / (SELECT scale FROM k), 1), 1) AS p FROM c{n})
SELECT doc_id, source, lang, topic, tokens, round(p, 9) AS probability, u < p AS kept
FROM d JOIN p USING (source, lang, topic)"""


@query(_mixing_sql())
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, probability and draw of every document, under the default targets."""
    rows = source_mixing.weigh(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "__cell.source", "__cell.lang", "__cell.topic", "__cell.tokens",
        F.round("__p", 9).alias("probability"),
        (source_mixing.draw() < F.col("__p")).alias("kept"))


@query(f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS10} AS w FROM documents),
i AS (SELECT row_number() OVER () AS ir, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS10} AS w
  FROM benchmark),
ip AS (
  SELECT ir, item_id, k AS j, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
  FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s(k) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, g FROM ip),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS s(k) WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, k, n, item_id FROM dw JOIN iw USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r),
pair AS (SELECT r, k, n, ir, item_id, j, k - row_number() OVER (PARTITION BY r, ir, k - j ORDER BY k) AS run
  FROM dw JOIN ip USING (n, g)),
runs AS (SELECT r, item_id, count(*) + n - 1 AS length, min(k) - 1 AS start, min(j) - 1 AS item_start
  FROM pair GROUP BY r, ir, item_id, n, k - j, run),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (
  PARTITION BY r ORDER BY length DESC, start, item_id, item_start) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(top.length, 0) AS BIGINT) AS longest,
       CAST(top.start AS BIGINT) AS longest_start, top.item_id AS longest_item,
       CAST(top.item_start AS BIGINT) AS longest_item_start
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN top USING (r)""")
def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontamination.matches(table(spark, sf_dir, "documents"),
                                           table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("longest.length", F.lit(0).cast("bigint")).alias("longest"),
        F.col("longest.start").alias("longest_start"), F.col("longest.item").alias("longest_item"),
        F.col("longest.item_start").alias("longest_item_start"))


_DIVERGENCE_SQL = rf"""WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term
      HAVING count(DISTINCT r) >= {source_divergence.LEAST_DOCS}),
c AS (SELECT g.lang, g.source, k.term, count(t.term) AS n, any_value(k.n) AS lang_n
      FROM g JOIN k ON k.lang = g.lang
      LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
      GROUP BY g.lang, g.source, k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total,
             count(*) OVER (PARTITION BY lang, source) AS v,
             sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total FROM c),
p AS (SELECT lang, source, term, n,
             1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p,
             1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM s),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
      FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
e AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(a.value, 0) AS value
      FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source
      LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = o.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM o WHERE part = 'pair' OR rank <= {source_divergence.TOP}"""


@query(_DIVERGENCE_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms each one overuses."""
    counts = source_divergence.count_terms(table(spark, sf_dir, "documents"))
    near = source_divergence.pairs(counts).withColumn("part", F.lit("pair"))
    over = source_divergence.terms(counts).withColumnRenamed("term", "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return near.select(*columns).unionByName(
        over.withColumn("part", F.lit("term")).select(*columns))


@query()
def op12_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    pieces = island_packing.cut(table(spark, sf_dir, "documents"), tokenizer_file())
    places = island_packing.place(pieces.select("row", "length"))
    digest = pieces.select("row", F.col("id").alias("doc_id"), "piece", "start",
                           F.col("length").cast("bigint").alias("length"),
                           F.crc32("ids").alias("ids_crc32"))
    return digest.join(places, "row").drop("row")


_TRIE_SQL = r"""WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, c - c % 20 AS base, count(*) AS n, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda k, i: xor(k >> 1, (k & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h FROM t GROUP BY c),
f AS (SELECT v.*, least(v.h, coalesce(b.n, 0)) AS taken FROM v LEFT JOIN v b ON b.c = v.base),
r AS (SELECT f.c, t.s AS d, role, txt FROM f JOIN t ON t.c = f.base AND t.s <= f.h
      UNION ALL SELECT t.c, t.s - f.h + f.taken, role, txt FROM t JOIN f USING (c) WHERE t.s > f.h),
p AS (SELECT c, d, len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS words,
        list({'r': role, 'x': txt}) OVER (PARTITION BY c ORDER BY d) AS path FROM r
      UNION ALL SELECT c, 0, 0, [] FROM f),
n AS (SELECT d, path, min(c) AS conv, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY d, path),
u AS (SELECT n.*, q.conv AS parent FROM n
      LEFT JOIN p ON p.c = n.conv AND p.d = n.d - 1 LEFT JOIN n q ON q.d = p.d AND q.path = p.path),
k AS (SELECT d - 1 AS d, parent AS conv, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (d, conv)),
a AS (SELECT q.d, q.conv, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
        sum((w.n_convs - 1) * w.words) AS saved
      FROM w JOIN p ON p.c = w.conv AND p.d <= w.d JOIN n q ON q.d = p.d AND q.path = p.path GROUP BY ALL),
l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
e AS (SELECT p.d, p.path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM l JOIN p USING (c, d) GROUP BY ALL)
SELECT CAST(w.conv AS BIGINT) AS conv_id, CAST(w.d AS BIGINT) AS depth, CAST(parent AS BIGINT) AS parent_conv_id,
       CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN a USING (d, conv) LEFT JOIN e ON e.d = w.d AND e.path = w.path"""


@query(_TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    found = prefix_trie.trie(table(spark, sf_dir, "conversations"))
    return found.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"),
        F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256"))
