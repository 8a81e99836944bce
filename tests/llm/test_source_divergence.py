"""The audit against a plain recomputation."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import source_divergence as op
from fieldtrace.llm.queries import ORACLES

from .conftest import ASCII_LOWER, with_clashes

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "lang string, source string, text string"))


def brute(rows, least, top):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = WORD.findall((text or "").translate(ASCII_LOWER))
        groups.add((lang, source))
        held[lang, source].update(words)
        held[lang, None].update(words)
        docs[lang].update(set(words))
    near, over = set(), set()
    for lang, source in groups:
        kept = [w for w, n in docs[lang].items() if n >= least]

        def p(other):
            total = sum(held[lang, other][w] for w in kept)
            return {w: 1 + 10 ** 9 * (held[lang, other][w] + 5) // (total + 5 * len(kept)) for w in kept}

        own, whole = p(source), p(None)
        far = [(-sum(abs(own[w] - q) for w, q in p(s).items()), s.encode(), s)
               for lg, s in groups if lg == lang and s != source]
        near |= {(lang, source, s, -v, r) for r, (v, _, s) in enumerate(sorted(far), 1)}
        most = sorted((whole[w] - own[w], w.encode(), w) for w in kept
                      if held[lang, source][w] and own[w] > whole[w])[:top]
        over |= {(lang, source, w, -v, r) for r, (v, _, w) in enumerate(most, 1)}
    return near, over


def sample(n=400):
    """Groups of all sizes; many words that tie within a group."""
    rng, rows = random.Random(3), []
    for k in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = rng.choice(["hot"] * 6 + ["a", "B", "é", "文", None, "rare"])
        words = [f"w{rng.choice('abcdefgh')}{'x' * rng.randrange(4)}" for _ in range(rng.randrange(40))]
        words += rng.sample(["Ünï", "THE", "the", "über", "Ź", "a1b", "don't"], 2)
        rows.append((lang, source, rng.choice([" ", "\n", ", "]).join(words)))
    rows += [("en", "empty", ""), ("en", "none", None), ("xx", "alone", "one two"), ("xx", "other", "  "),
             ("en", "hot", "long word " * 20_000)] + [("de", "copy", "ties equal here same")] * 12
    return rows


@pytest.mark.parametrize("cells,chunk", [(op.BROADCAST_CELLS, op.CHUNK_ROWS), (0, 7)])
def test_against_brute_force(spark, cells, chunk):
    rows = sample()
    counts = op.count_terms(frame(spark, rows).repartition(5), least_docs=10)
    near, over = brute(rows, 10, 6)
    assert {tuple(r) for r in op.pairs(counts, chunk).collect()} == near
    got = op.terms(counts, 6, cells).collect()
    assert {tuple(r) for r in got} == over and len(got) == len(over)


def test_a_task_passes_words_on_when_it_holds_many(spark):
    """The tally emptied after each slice gives the same counts."""
    import pyarrow as pa
    rows = sample(60)
    batch = pa.RecordBatch.from_pylist(
        [{"lang": a or "", "source": b or "", "text": c or ""} for a, b, c in rows])
    held, sums = op.HELD, []
    for most in (held, 0):
        op.HELD = most
        try:
            total = Counter()
            for part in op._count(iter([batch, batch])):
                for r in part.to_pylist():
                    total[r["lang"], r["source"], r["term"]] += r["n"]
        finally:
            op.HELD = held
        sums.append(total)
    assert sums[0] == sums[1] and sum(sums[0].values()) > 1_000


def test_no_kept_terms_and_empty_table(spark):
    counts = op.count_terms(frame(spark, [("en", "a", "x y"), ("en", "b", None), ("de", None, "z")]))
    assert {tuple(r) for r in op.pairs(counts).collect()} == {("en", "a", "b", 0, 1), ("en", "b", "a", 0, 1)}
    assert op.terms(counts).count() == 0
    none = op.count_terms(frame(spark, []))
    assert op.pairs(none).count() == 0 and op.terms(none).count() == 0


def test_share_is_exact_beyond_64_bits(spark):
    cases = [(0, 1, 1), (7, 9, 2), (3 * 10 ** 14, 10 ** 15, 12_345), (10 ** 15, 10 ** 15, 10 ** 8)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    for r in df.withColumn("p", op.share("n", "total", "v")).collect():
        assert r.p == 1 + 10 ** 9 * (r.n + 5) // (r.total + 5 * r.v)


def test_sql(spark):
    rows = sample() + [("en", "hot", "again")] * 40
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)],
                               "doc_id long, lang string, source string, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(ORACLES["op11_source_divergence"]).fetchall()
    counts = op.count_terms(df)
    got = {("pair", *r) for r in op.pairs(counts).collect()} | {("term", *r) for r in op.terms(counts).collect()}
    assert got == {(r[2], r[0], r[1], *r[3:]) for r in want} and len(got) == len(want)
