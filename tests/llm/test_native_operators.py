"""License scan, chat formatting and source mixing: brute force, edge cases, plans."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import chat_perspectives, license_diagonals, source_mixing
from fieldtrace.llm.queries import ORACLES, QUERIES

from ..conftest import SMALL
from .conftest import EDGES, letter_words, text_frame, with_clashes


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# -- licenses --------------------------------------------------------------------

NOTICES = [
    (91_001, "All rights\nreserved. CC-BY all RIGHTS reserved cc by"),
    (91_002, "Released under the MIT License."),
    (91_003, "released quite under the very mit license"),          # two words more
    (91_004, "Redistribution and use in source and binary forms, with or without any modification, "
             "are permitted provided that these following conditions are met"),
    (91_005, "of the of the of the in the license to the use of the " * 40),
    (91_006, "GENERAL PUBLIC LICENSE" * 3), (91_007, "general public license " * 3),
    (91_001, "All rights\nreserved. CC-BY all RIGHTS reserved cc by"), (91_001, "other text cc by"),
    (91_008, "éall rights reserved"), (91_009, "K all rights reserved İ"),
]


def base_places(text):
    words = letter_words(text)
    out = []
    for phrase, label in license_diagonals.BASE:
        own = phrase.split()
        out += [(label, k) for k in range(len(words) - len(own) + 1) if words[k:k + len(own)] == own]
    return len(words), sorted(out)


def test_license_base_places(spark, sample_texts):
    rows = sample_texts + EDGES + NOTICES
    found = license_diagonals.scan(text_frame(spark, rows))
    assert no_python(found)
    got = sorted(((r.id, r.n_words, sorted((p.label, p.start) for p in r.places if p.base))
                  for r in found.collect()), key=repr)
    # Rows that share id and text are one document.
    assert got == sorted(((d, *base_places(t)) for d, t in set(rows)), key=repr)


def test_license_query_on_repeated_rows(spark, tmp_path):
    """One row per row, as the query's SQL has it."""
    rows = [(1, "cc by x")] * 3 + [(None, "All rights reserved")] * 4 + [(None, None)] * 2 + [(2, "no"), (1, "y")]
    text_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op5_license_diagonals"](spark, str(tmp_path))
    want = con.sql(ORACLES["op5_license_diagonals"])
    assert len(want.fetchall()) == len(rows) and sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(
        map(repr, con.sql(ORACLES["op5_license_diagonals"]).fetchall()))


def test_license_templates(spark):
    rows = license_diagonals.scan(text_frame(spark, NOTICES)).collect()
    labels = {}
    for r in rows:
        labels.setdefault(r.id, set()).update(p.label for p in r.places)
        assert all(0 < p.share <= 1 and p.stop > p.start for p in r.places)
    assert labels[91_002] == {"mit"} and labels[91_004] == {"bsd"}
    assert labels[91_003] == set() and labels[91_005] == set()
    assert labels[91_007] == {"gpl"} and labels[91_006] == set()   # words run together
    assert license_diagonals.scan(text_frame(spark, [])).count() == 0


def test_license_beside_partial_repeats(spark):
    """A whole template counts though repeats near it stretch its band."""
    mit = "Released under the MIT License. The MIT License permits"
    found = license_diagonals.scan(text_frame(spark, [
        (1, mit), (2, f"{mit} all. {mit}"), (3, "the mit license the mit license the mit license"),
        (4, "Released under the very MIT License. The MIT License permits")])).collect()
    got = {r.id: [(p.label, p.start, p.stop, p.share) for p in r.places] for r in found}
    assert got[1] == [("mit", 0, 5, 1.0)] and got[3] == []
    assert got[2] == [("mit", 0, 5, 1.0), ("mit", 10, 15, 1.0)]
    assert got[4] == [("mit", 0, 6, 0.75)]


MIT = "Released under the MIT License. The MIT License permits"
STRETCHED = [(1, MIT), (2, f"{MIT} all. {MIT}"), (3, "the mit license the mit license the mit license"),
             (4, f"cc by {MIT} " * 30), (5, "the license under the mit released under " * 20), (6, None), (6, None),
             (7, "Licensed under CC BY NC 4.0 cc by nc 4 licensed under cc by sa 4.0 by sa 4 0 " * 3),
             (8, " ".join(license_diagonals.TEMPLATES[-3][0].split()[9:150]).upper()), (None, MIT), (None, MIT)]


def test_license_sql_on_stretched_bands(spark, tmp_path):
    text_frame(spark, STRETCHED + NOTICES).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op5_license_diagonals"](spark, str(tmp_path))
    want = con.sql(ORACLES["op5_license_diagonals"])
    rows = [tuple(r) for r in got.select(*want.columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
    labels = {r[0]: r[want.columns.index("labels")] for r in rows}
    assert labels[1] == "mit" and labels[4] == "cc-by,mit" and labels[8] == "mit"


@pytest.mark.parametrize("most", [license_diagonals.BROADCAST_PAIRS, 0])
def test_license_own_templates(spark, most):
    """Templates are a table; many are joined in salted copies."""
    own = with_clashes(spark.createDataFrame(
        [("Free as in  freedom, always",), ("free as in freedom always",), ("one",), (None,), ("",)],
        "text string")).withColumn("label", F.lit("free")).unionByName(
            spark.createDataFrame([("nobody names this one",)], "text string"), allowMissingColumns=True)
    docs = text_frame(spark, [(1, "it is FREE as in freedom always cc by"), (2, MIT), (3, "nobody names this one"),
                              (4, None), (4, None)])
    found = license_diagonals.scan(docs, templates=own, broadcast_pairs=most, each_row=True)
    assert no_python(found)
    assert sorted((r.id, r.n_words, [(p.label, p.start, p.stop, p.share) for p in r.places])
                  for r in found.collect()) == [
        (1, 9, [("cc-by", 7, 9, 1.0), ("free", 2, 7, 1.0)]), (2, 9, []), (3, 4, []), (4, 0, []), (4, 0, [])]


# -- chats -----------------------------------------------------------------------

CHATS = [(1, 0, "system", "Be kind."), (1, 1, "ana", "hi"), (1, 2, "bo", "yo <|end|> x"), (1, 2, "bo", "yo"),
         (1, 2, "bo", "yo"), (1, None, None, None), (2, 0, "system", "alone"), (None, 3, "cy", "ü"),
         (3, 5, "", "last"), (3, 4, "ana", "long " * 9000)]


def rendered(rows, size):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append(((turn is not None, turn), role or "unknown",
                                           (text or "").replace("<|", "< |")))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0][0], t[0][1] or 0, t[1], t[2]))
        for seat in {t[1] for t in turns} - {"system"}:
            for part in range(0, len(turns), size):
                text, mask = "", []
                for _, who, said in turns[part:part + size]:
                    name = ("assistant" if who == seat else "system" if who == "system"
                            else f"user:{who}")
                    text += f"<|{name}|>\n"
                    begin = len(text)
                    text += f"{said}<|end|>\n"
                    if who == seat:
                        mask.append((begin, len(text) - 1))
                out.append((conv, seat, part // size, len(turns[part:part + size]), text, mask))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [64, 2])
def test_perspectives(spark, size):
    chats = with_clashes(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"))
    found = chat_perspectives.perspectives(chats, part_turns=size)
    assert no_python(found)
    got = sorted(((r.conv, r.speaker, r.part, r.n_turns, r.text, [tuple(m) for m in r["mask"]])
                  for r in found.collect()), key=repr)
    assert got == rendered(CHATS, size)
    for conv, seat, _, _, text, mask in got:
        assert all(text[a:b].endswith("<|end|>") for a, b in mask)
    assert chat_perspectives.perspectives(chats.limit(0)).count() == 0


# -- mixing ----------------------------------------------------------------------

def corpus(spark):
    rows = [(k, f"word number{k} " * (1 + k % 7) + ("Copyright x" if k % 11 == 0 else ""),
             f"s{min(k % 10, 3)}", ("en", "de")[k % 3 == 0]) for k in range(600)]
    rows += [(None, "a b", None, ""), (700, None, "s0", "en"), (701, "", "s9", None), (5, rows[5][1], "s3", "en")]
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))


def shares(spark, **values):
    return {m: spark.createDataFrame(list(v.items()), "value string, share double")
            for m, v in values.items()}


def test_rake_meets_the_margins(spark):
    cells = source_mixing.settle(source_mixing.count_cells(corpus(spark).where("doc_id < 600")))
    have = {m: {r[0]: 1.0 + k for k, r in enumerate(sorted(
        cells.where("tokens > 0").select(m).distinct().collect()))} for m in source_mixing.MARGINS}
    targets = shares(spark, **{m: {**v, "never seen": 5.0} for m, v in have.items()})
    raked = source_mixing.rake(cells, targets, rounds=25).collect()
    for m, wanted in have.items():
        size = sum(r["tokens"] * r["weight"] for r in raked)
        for value, share in wanted.items():
            got = sum(r["tokens"] * r["weight"] for r in raked if r[m] == value) / size
            assert abs(got - share / sum(wanted.values())) < 0.02


def test_sample(spark):
    docs = corpus(spark)
    weighed = source_mixing.weigh(docs)
    assert no_python(weighed)
    rows = weighed.select("doc_id", "text", "__p", source_mixing.draw().alias("u")).collect()
    assert len(rows) == docs.count() and all(0 <= r["__p"] <= 1 and 0 <= r.u < 1 for r in rows)
    kept = source_mixing.sample(docs)
    assert kept.columns == docs.columns
    want = sorted(((r.doc_id, r.text) for r in rows if r.u < r["__p"]), key=repr)
    assert sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()), key=repr) == want
    assert sorted(map(repr, source_mixing.sample(docs).collect())) == sorted(map(repr, kept.collect()))


@pytest.mark.parametrize("stray", [0, 1, 3])
def test_mixing_sql_with_stray_documents(spark, tmp_path, stray):
    """The statement has the rule for scarce cells, too."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source", "lang")
    more = [(10 ** 9, "a stray note", "rare", "xx"), (10 ** 9 + 1, "two words", None, "en"),
            (10 ** 9 + 2, "7 8 9", "odd", "")][:stray]
    docs = docs.unionByName(docs.limit(20)).unionByName(
        spark.createDataFrame(more, docs.schema) if more else docs.limit(0))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(repr, con.sql(ORACLES["op9_source_mixing"]).fetchall()))
    got = sorted(repr(tuple(r)) for r in QUERIES["op9_source_mixing"](spark, str(tmp_path)).collect())
    assert got == want


def test_stray_document_leaves_the_rest(spark):
    """One short document with a source and language of its own does not set the scale."""
    docs = corpus(spark).where("doc_id < 600").withColumn("text", F.repeat("text", F.lit(300)))
    docs = docs.unionByName(docs.limit(1).withColumns(
        {"doc_id": F.lit(900), "text": F.lit("a stray note"), "source": F.lit("rare"), "lang": F.lit("xx")}))
    rows = source_mixing.weigh(docs).select("__cell.*", "__p").collect()
    size = sum(r.tokens for r in rows)
    assert source_mixing.LEAST_KEPT - 1e-9 <= sum(r.tokens * r["__p"] for r in rows) / size
    raked = source_mixing.settle(source_mixing.rake(
        cells := source_mixing.settle(source_mixing.count_cells(docs)), source_mixing.tempered_targets(cells)))
    exact = {tuple(r)[:3]: r.probability for r in source_mixing.probabilities(raked).collect()}
    assert sum(r.tokens * exact[r.source, r.lang, r.topic] for r in rows) / size < 0.3
    # The cells that are not capped keep their proportions.
    ratios = {round(r["__p"] / exact[r.source, r.lang, r.topic], 6) for r in rows if r["__p"] < 1}
    assert len(ratios) == 1
    # Given targets are met unless a share is stated; more than there is keeps all.
    even = shares(spark, source={v: 1.0 for v in ("s0", "s1", "s2", "s3", "rare")})
    few, all_ = (source_mixing.weigh(docs, even, least_kept=x).select("__cell.tokens", "__p").collect()
                 for x in (None, 1.0))
    assert sum(r.tokens * r["__p"] for r in few) < 0.1 * size and {r["__p"] for r in all_} == {1.0}


def test_zero_targets_and_empty(spark):
    docs = corpus(spark)
    only = shares(spark, lang={"en": 1.0})
    kept = source_mixing.sample(docs, only).where("lang = 'de' AND length(text) > 0")
    assert kept.count() == 0
    assert source_mixing.sample(docs.limit(0)).count() == 0
    share = source_mixing.rake(source_mixing.count_cells(docs), only, rounds=1)
    got = {(r["value"], round(r["share"], 9)) for r in source_mixing.deviation(share, only).collect()}
    assert ("en", 1.0) in got


def test_words_and_topics(spark):
    texts = ["a  b\tc\n", "", None, "1 2 3", "x | y", "Licensed to no one", "plain text here"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(
        source_mixing.tokens_of(F.col("text")).alias("n"),
        source_mixing.topic_of(F.col("text"), source_mixing.tokens_of(F.col("text"))).alias("t")).collect()
    assert [tuple(r) for r in got] == [(3, "prose"), (0, "prose"), (0, "prose"), (3, "data"), (3, "table"),
                                       (4, "legal"), (3, "prose")]
