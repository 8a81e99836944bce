"""License scan by diagonal voting, in DataFrame operations only.

All rolling word pairs of every text are hashed and joined to the positions of
the same pairs in a table of templates.  A hit votes for the diagonal "place
in the text minus place in the template".  Diagonals of a template that lie next
to each other are merged, so that a few words more or less do not break a match,
and a merged span counts if enough of the template's pairs voted and it is not
much longer than the template.  A band with enough votes that is too long, since
partial repeats nearby were merged into it, gives its best runs of diagonals that
meet both.  The short base phrases must match exactly: one
diagonal with all votes.  Hashes only propose: a hit votes if its words are the
template's words, so the share of a span is one of words that stand there.

Only hits and one mark per text leave the join, and they are counted per text
before anything is shuffled; the pairs themselves never move.  A caller may give
templates of their own as a table.  The templates are broadcast while they have at
most ``BROADCAST_PAIRS`` pairs; beyond that they are joined in salted copies.

Edge cases: null texts have no words.  Rows that share id and text are one
document, unless ``each_row`` is set; ids may be null.  Templates without a label,
or with fewer than two words, match nothing; equal ones count once.  Empty tables
give empty results.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import settle

# --- fixed values: base phrases and their labels --------------------------------
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# --- fixed values: wording of public licenses, as words --------------------------
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction",
     "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the "
     "license at", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense "
     "and or sell copies of the software and to permit persons to whom the software is furnished to "
     "do so subject to the following conditions the above copyright notice and this permission notice "
     "shall be included in all copies or substantial portions of the software the software is "
     "provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement in no event "
     "shall the authors or copyright holders be liable for any claim damages or other liability "
     "whether in an action of contract tort or otherwise arising from out of or in connection with "
     "the software or the use or other dealings in the software", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without "
     "fee is hereby granted provided that the above copyright notice and this permission notice "
     "appear in all copies the software is provided as is and the author disclaims all warranties "
     "with regard to this software including all implied warranties of merchantability and fitness "
     "in no event shall the author be liable for any special direct indirect or consequential damages "
     "or any damages whatsoever resulting from loss of use data or profits whether in an action of "
     "contract negligence or other tortious action arising out of or in connection with the use or "
     "performance of this software", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the "
     "gnu general public license as published by the free software foundation", "gpl"),
)
# ---------------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Diagonals up to this far apart are merged.
GAP = 3
# Share of a template's pairs that must vote, and the longest span over its length.
LEAST_SHARE = 0.75
STRETCH = 1.5
# Template pairs that are broadcast, and the copies they are joined in beyond that.
BROADCAST_PAIRS = 200_000
SALTS = 64


def words_of(text: Column) -> Column:
    """The words of a text in lower case (A-Z only); null gives none."""
    # Lowering all letters of an ASCII text is the same and cheaper.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORDS), 0), F.array().cast("array<string>"))


def pairs_of(words: str) -> Column:
    """``(hash, a, b)`` of each two words in a row, from one with no ``a`` before
    the first word to one with no ``b`` after the last."""
    ahead = F.concat(F.array(F.lit(None).cast("string")), F.col(words))
    return F.zip_with(ahead, F.col(words), lambda a, b: F.struct(
        F.xxhash64(a, b).alias("hash"), a.alias("a"), b.alias("b")))


def template_pairs(spark: SparkSession, templates: DataFrame | None = None) -> DataFrame:
    """``(template, label, exact, pairs, tpos, pair)``, one row per word pair of the
    base phrases and of ``templates`` (``text``, ``label``), or those of this module."""
    def fixed(rows):
        values = ", ".join(f"('{text}', '{label}')" for text, label in rows)
        return spark.sql(f"SELECT * FROM VALUES {values} AS t(text, label)")

    table = fixed(BASE).withColumn("exact", F.lit(True))
    templates = fixed(TEMPLATES) if templates is None else templates
    table = table.unionByName(templates.select("text", "label", F.lit(False).alias("exact")))
    table = table.where("label IS NOT NULL").select("label", "exact", words_of(F.col("text")).alias("words"))
    table = table.select(F.xxhash64("label", "exact", "words").alias("template"), "*").distinct()
    return table.select(
        "template", "label", "exact", (F.size("words") - 1).alias("pairs"),
        F.posexplode(F.slice(pairs_of("words"), F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))))
        .alias("tpos", "pair"))


def hits(pairs: DataFrame, templates: DataFrame, broadcast: bool) -> DataFrame:
    """The pairs that stand in a template, once per place there, and all marks."""
    same = ((F.col("t.pair.hash") == F.col("p.pair.hash")) & (F.col("t.pair.a") == F.col("p.pair.a"))
            & (F.col("t.pair.b") == F.col("p.pair.b")))
    if broadcast:
        templates = F.broadcast(templates.alias("t"))
    else:
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("print", "pos"), F.lit(SALTS)))
        templates = templates.withColumn("salt", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))).alias("t")
        same = same & (F.col("t.salt") == F.col("p.salt"))
    voted = pairs.alias("p").join(templates, same, "left")
    return voted.where((F.col("p.pos") < 0) | F.col("t.template").isNotNull()).select(
        "p.id", "p.print", "p.part", "p.n_words", "p.pos", "t.template", "t.label", "t.exact",
        "t.pairs", "t.tpos")


def best_runs(lines: Column, pairs: Column) -> Column:
    """``(missed, length, start, stop)`` of runs of diagonals that fit, the best
    first and none that overlaps a better one.

    ``lines`` are a band's ``(diagonal, tpos)`` in order.  A run that fits cannot
    reach further than its span and the template, which bounds the work.
    """
    reach = (F.ceil(F.lit(STRETCH) * (pairs + 1)) + pairs + 1).cast("int")
    none = F.lit(None).cast("struct<missed:int,length:int,start:int,stop:int>")

    def longer(run, line):
        seen = F.array_union(run["seen"], line["tpos"])
        start = F.least(run["start"], line["diagonal"] + F.array_min(line["tpos"]))
        stop = F.greatest(run["stop"], line["diagonal"] + F.array_max(line["tpos"]) + 2)
        missed, length = pairs - F.size(seen), stop - start
        better = ((missed <= (1 - LEAST_SHARE) * pairs) & (length <= STRETCH * (pairs + 1))
                  & F.coalesce(missed < run["best"]["missed"], F.lit(True)))
        return F.struct(seen.alias("seen"), start.alias("start"), stop.alias("stop"), F.when(
            better, F.struct(missed.alias("missed"), length.alias("length"), start.alias("start"),
                             stop.alias("stop"))).otherwise(run["best"]).alias("best"))

    zero = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(None).cast("int").alias("start"),
                    F.lit(None).cast("int").alias("stop"), none.alias("best"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(
        F.sequence(F.lit(1), F.size(lines)),
        lambda k: F.aggregate(F.slice(lines, k, reach), zero, longer)["best"]), lambda b: b.isNotNull())))
    return F.aggregate(
        found, F.filter(F.array(none), lambda b: b.isNotNull()),
        lambda kept, b: F.when(
            F.exists(kept, lambda c: (b["start"] < c["stop"]) & (c["start"] < b["stop"])), kept)
        .otherwise(F.concat(kept, F.array(b))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         each_row: bool = False, templates: DataFrame | None = None,
         broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``(id, n_words, places)`` for each document, or with ``each_row`` for each row.

    ``places`` has the spans found: label, whether a base phrase, first word,
    word after the last, and the share of the template that voted.  ``templates``
    (``text``, ``label``) take the place of the module's own; their pairs are
    counted by a job.
    """
    known = template_pairs(docs.sparkSession, templates)
    broadcast = True
    if templates is not None:
        known = settle(known)
        broadcast = known.count() <= broadcast_pairs
    # Repeated rows are counted per partition and given back at the end, so many of them
    # spread over the tasks; which rows a partition has does not change when it is rerun.
    part = F.spark_partition_id() if each_row else F.lit(0)
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"),
                        part.alias("part"), words_of(F.col(text_col)).alias("words"))
    pairs = words.select("id", "print", "part", F.size("words").alias("n_words"),
                         F.posexplode(pairs_of("words")).alias("pos", "pair"))
    voted = hits(pairs.withColumn("pos", F.col("pos") - 1), known, broadcast)
    text = ["id", "print", "part", "n_words"]
    # The pair before the first word marks a row: it carries the texts without hits.
    diagonals = (voted.groupBy(*text, "template", "label", "exact", "pairs",
                               (F.col("pos") - F.col("tpos")).alias("diagonal"))
                 .agg(F.collect_set("tpos").alias("tpos"),
                      F.sum((F.col("pos") < 0).cast("bigint")).alias("copies")))
    line = Window.partitionBy("id", "print", "part", "template").orderBy("diagonal")
    # The base phrases are not merged.
    apart = (F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(line) > GAP))
    merged = diagonals.withColumn("band", F.sum(F.when(apart, 1).otherwise(0)).over(
        line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = (merged.groupBy(*text, "template", "label", "exact", "pairs", "band")
             .agg(F.array_sort(F.collect_list(F.struct("diagonal", "tpos"))).alias("lines"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("votes"),
                  F.min(F.col("diagonal") + F.array_min("tpos")).alias("start"),
                  (F.max(F.col("diagonal") + F.array_max("tpos")) + 2).alias("stop"),
                  F.sum("copies").alias("copies")))
    enough = F.when(F.col("exact"), F.col("votes") == F.col("pairs")).otherwise(
        F.col("votes") >= LEAST_SHARE * F.col("pairs"))
    short = F.col("exact") | (F.col("stop") - F.col("start") <= STRETCH * (F.col("pairs") + 1))

    def place(start, stop, votes):
        return F.struct("label", F.col("exact").alias("base"), start.cast("bigint").alias("start"),
                        stop.cast("bigint").alias("stop"), (votes / F.col("pairs")).alias("share"))

    places = (F.when(enough & short, F.array(place(F.col("start"), F.col("stop"), F.col("votes"))))
              .when(enough, F.transform(best_runs(F.col("lines"), F.col("pairs")), lambda b: place(
                  b["start"], b["stop"], F.col("pairs") - b["missed"]))))
    found = (spans.groupBy(*text)
             .agg(F.array_sort(F.flatten(F.collect_list(places))).alias("places"),
                  F.sum("copies").alias("copies")))
    if each_row:
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return found.select("id", F.col("n_words").cast("bigint").alias("n_words"), "places")
