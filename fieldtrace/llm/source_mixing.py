"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic), each with its
tokens.  Rounds of raking multiply the cells' weights so that the weighted
tokens of each source, then each language, then each topic get their target
shares; the last margin raked is met exactly, the others as closely as the
rounds allow (:func:`deviation` tells).  A document is kept with the probability
of its cell: its weight over the largest weight, so that the kept tokens have
the target shares in expectation.  Under the default targets that may not keep
less than ``LEAST_KEPT`` of the tokens: where a scarce cell would lower the rest
below it, cells beyond a smaller scale are kept whole (and fall short of their
target), and the others are raised in proportion until that share is reached.
The draw is a hash of the document's id, so a run can be repeated and another
machine draws alike.

Everything is DataFrame expressions.  Only the cells are raked; there are at
most as many as combinations that occur, and the rows are counted before they
are shuffled, so a hot source costs nothing.

Edge cases: null margins are the category "unknown"; a null text has no tokens.  A
target of a value that does not occur is left out, values without a target get
weight 0, and a margin whose targets all miss stays as it is.  Documents with a
null id are drawn by their text.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settle, work_folder

ROUNDS = 5
SEED = "mix-1"
# Share of the tokens in wanted cells that the default targets keep at least.
LEAST_KEPT = 0.4
# Cells up to this many are broadcast to the documents.
BROADCAST_CELLS = 100_000

WORDS = r"[^ \t\n\x0B\f\r]+"
LEGAL = "([Ll]icen[sc]e|[Cc]opyright|rights reserved)"
NUMBERS = "[0-9]+"

MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.85, "lang": 0.85, "topic": 0.9}


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic of a whole text: legal, data, table or prose."""
    numbers = F.coalesce(F.regexp_count(text, F.lit(NUMBERS)), F.lit(0))
    return (F.when(F.coalesce(text.rlike(LEGAL), F.lit(False)), "legal")
            .when(numbers * 20 > tokens, "data")
            .when(F.coalesce(F.contains(text, F.lit(" | ")), F.lit(False)), "table")
            .otherwise("prose"))


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one column ``__cell`` that holds the margins and tokens."""
    def named(c):
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))

    tokens = tokens_of(F.col(text_col))
    return docs.withColumn("__cell", F.struct(
        named("source").alias("source"), named("lang").alias("lang"),
        topic_of(F.col(text_col), tokens).alias("topic"), tokens.alias("tokens")))


def count_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    rows = described(docs, text_col).select("__cell.*")
    return rows.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("tokens"),
                                      F.count(F.lit(1)).alias("docs"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS,
         folder: str | None = None) -> DataFrame:
    """The cells with a column ``weight``.

    ``targets`` has for each margin a frame ``(value, share)``; the shares of
    the values that occur are scaled to 1.  Each step is written out, so no plan
    grows with the rounds.
    """
    folder = folder or work_folder(cells.sparkSession)
    wanted = {}
    for margin, shares in targets.items():
        present = cells.where("tokens > 0").select(F.col(margin).alias("value")).distinct()
        known = shares.join(present, "value", "left_semi")
        known = settle(known, folder)
        total = known.agg(F.sum("share")).first()[0]
        wanted[margin] = known.select(
            F.col("value").alias(margin), (F.col("share") / F.lit(total)).alias("__share"))
    now = settle(cells.withColumn("weight", F.lit(1.0)), folder)
    size = now.agg(F.sum("tokens")).first()[0] or 0.0
    for _ in range(rounds):
        for margin, shares in wanted.items():
            have = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("__have"))
            factor = have.join(shares, margin, "left").select(margin, F.when(
                F.col("__have") > 0,
                F.coalesce("__share", F.lit(0.0)) * F.lit(size) / F.col("__have")
            ).otherwise(F.lit(1.0)).alias("__factor"))
            now = settle(now.join(factor, margin).withColumn(
                "weight", F.col("weight") * F.col("__factor")).select(
                    *cells.columns, "weight"), folder)
    return now


def deviation(raked: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """``(margin, value, share, target)`` after raking."""
    size = raked.agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0] or 1.0
    out = None
    for margin, shares in targets.items():
        got = raked.groupBy(F.col(margin).alias("value")).agg(
            (F.sum(F.col("tokens") * F.col("weight")) / size).alias("share"))
        part = got.join(shares.withColumnRenamed("share", "target"), "value", "left").select(
            F.lit(margin).alias("margin"), "value", "share", "target")
        out = part if out is None else out.unionByName(part)
    return out


def tempered_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """Default targets: powers of the tokens that raise what is rare a little."""
    return {margin: cells.groupBy(F.col(margin).alias("value")).agg(
        F.pow(F.sum("tokens"), F.lit(power)).alias("share")) for margin, power in TEMPER.items()}


def draw(id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> Column:
    """A number from 0 (included) to 1 for a document, the same in every run."""
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed + ":"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def scale(raked: DataFrame, least_kept: float = 0.0) -> float | None:
    """The weight from which on a cell is kept whole; null without tokens.

    It is the largest weight, or the largest scale that keeps ``least_kept`` of
    the tokens in cells with a weight.  The kept tokens are concave in 1 / scale,
    so the steps approach that scale from above and stop when no further cell is
    capped.
    """
    cells = raked.where("tokens > 0")
    size, most = cells.agg(F.sum(F.when(F.col("weight") > 0, F.col("tokens"))),
                           F.max("weight")).first()
    capped, now = None, most
    while now:
        whole = F.col("weight") >= F.lit(now)
        n, full, part = cells.agg(
            F.count_if(whole), F.sum(F.when(whole, F.col("tokens")).otherwise(0.0)),
            F.sum(F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        if n == capped or not part or full + part / now >= least_kept * size:
            break
        capped, now = n, part / (least_kept * size - full)
    return now


def probabilities(raked: DataFrame, least_kept: float = 0.0) -> DataFrame:
    """``(source, lang, topic, probability)``: weights over :func:`scale`, capped
    at 1.  Cells without tokens get 1 where there is no scale."""
    whole = scale(raked, least_kept)
    p = F.coalesce(F.least(F.col("weight") / F.lit(whole), F.lit(1.0)), F.lit(1.0))
    return raked.select(*MARGINS, p.alias("probability"))


def weigh(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None,
          text_col: str = "text", rounds: int = ROUNDS,
          least_kept: float | None = None) -> DataFrame:
    """The documents with ``__cell`` and ``__p``, the probability of each.

    ``least_kept`` is ``LEAST_KEPT`` for the default targets; given targets are
    met whatever they keep, unless it is stated.
    """
    if least_kept is None:
        least_kept = 0.0 if targets else LEAST_KEPT
    folder = work_folder(docs.sparkSession)
    cells = settle(count_cells(docs, text_col), folder)
    raked = rake(cells, targets or tempered_targets(cells), rounds, folder)
    chance = settle(probabilities(raked, least_kept), folder).select(
        F.struct(*MARGINS).alias("__key"), F.col("probability").alias("__p"))
    if cells.count() <= BROADCAST_CELLS:
        chance = F.broadcast(chance)
    rows = described(docs, text_col)
    key = F.struct(*[F.col("__cell")[m].alias(m) for m in MARGINS])
    return rows.join(chance, key == F.col("__key"), "left").drop("__key")


def sample(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None,
           id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
           seed: str = SEED, least_kept: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns unchanged."""
    rows = weigh(docs, targets, text_col, rounds, least_kept)
    return (rows.where(draw(id_col, text_col, seed) < F.col("__p"))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
