"""Source divergence audit: how far the words of a source stray from its language.

Each language keeps the terms that at least ``LEAST_DOCS`` of its documents hold.
A group is a language and a source.  A group, or a language, gives a kept term

    p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)),

where N counts all places of kept terms there and V is the number of kept terms.
Two audits follow, in whole numbers throughout:

* :func:`pairs`: for each group every other source of the language, with the sum
  of ``abs(p - q)`` over the kept terms, ranked;
* :func:`terms`: for each group the kept terms that it uses more than the
  language does, with ``p - q``, the first ``TOP`` of them.

The terms are ranked by count cells.  Terms of a group that agree in their count
there and in the language have the same value, so the value is taken once per
cell, equal values are merged, and the cells are ranked by the terms before them.
Only the cells that reach the first ``TOP`` ranks are expanded to terms, in the
order of their UTF-8 bytes.  So what is sorted grows with the distinct counts, not
with the vocabulary.

Python counts the words of a task's documents (numpy, bounded tables) and adds up
the differences of whole blocks of terms; all else is DataFrame operations.

Edge cases: null language, source and text read as empty; a group without any
kept term takes part with counts of zero; languages that keep no term give pairs
of value 0 and no terms.  Repeated rows are documents of their own.  An empty
table gives no rows, other columns are not read, texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import settle, text_batches, utf8, work_folder
from .wordbytes import span_hashes, words_in

LEAST_DOCS = 30
TOP = 50
UNIT = 10 ** 9
# Added to each count.
EXTRA = 5
# Words and (group, word) entries that a task holds before it passes them on.
HELD = 400_000
# Rows of kept terms whose differences one task adds up, and numbers it holds for them.
CHUNK_ROWS = 200_000
BLOCK_CELLS = 2_000_000
# Groups, and chosen cells, that are broadcast; beyond that they are joined by shuffle.
BROADCAST_GROUPS = 20_000
BROADCAST_CELLS = 200_000
SALTS = 64

_BYTE = np.arange(256)
# [^\x00-\x40\x5B-\x60\x7B-\x7F]+, on lower-cased text
LETTERS = ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)


# -- counting ------------------------------------------------------------------

class Tally:
    """Places and documents of each word in each group, for the documents of a task."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self._clear()

    def _clear(self):
        self.codes: dict[int, int] = {}
        self.words: list[bytes] = []
        self.checks: list[int] = []
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def _codes(self, words, hashes: np.ndarray, checks: np.ndarray, one: np.ndarray):
        """The number of each distinct word; new ones are added."""
        found = np.fromiter((self.codes.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(found < 0)
        found[new] = np.arange(len(self.words), len(self.words) + len(new))
        self.codes.update(zip(hashes[new].tolist(), found[new].tolist()))
        raw = words.data.tobytes()
        at, to = words.start[one[new]].tolist(), words.end[one[new]].tolist()
        self.words += [raw[a:b] for a, b in zip(at, to)]
        self.checks += checks[new].tolist()
        known = np.fromiter((self.checks[k] for k in found.tolist()), np.uint64, len(found))
        if (known != checks).any():
            raise ValueError("two words share a hash")
        return found

    def add(self, words, group: np.ndarray) -> None:
        """Count the words of a slice of texts, whose groups are given."""
        if not len(words.start):
            return
        hashes = span_hashes(words.data, words.start, words.end)
        checks = span_hashes(words.data, words.start, words.end, 1)
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if (checks[one][which] != checks).any():
            raise ValueError("two words share a hash")
        code, n, text = self._codes(words, distinct, checks[one], one), len(distinct), words.text_of()
        # Both are sorted alike: by group, then by word of this slice.
        places, count = np.unique(group[text] * n + which, return_counts=True)
        once = np.unique(text * n + which)
        _, docs = np.unique(group[once // n] * n + once % n, return_counts=True)
        self.entries.append(((places // n << 32) + code[places % n], count, docs))
        self.size += len(places)

    def merge(self) -> None:
        """One entry per group and word."""
        if self.entries:
            key, place = np.unique(np.concatenate([e[0] for e in self.entries]), return_inverse=True)
            sums = []
            for k in (1, 2):
                total = np.zeros(len(key), np.int64)
                np.add.at(total, place, np.concatenate([e[k] for e in self.entries]))
                sums.append(total)
            self.entries = [(key, *sums)]
            self.size = len(key)

    def rows(self) -> pa.RecordBatch:
        """What was counted, and each group once with a null term; counting starts anew."""
        self.merge()
        key, count, docs = self.entries[0] if self.entries else (np.empty(0, np.int64),) * 3
        langs = pa.array([g[0] for g in self.groups], pa.string())
        sources = pa.array([g[1] for g in self.groups], pa.string())
        group, word = pa.array(key >> 32), pa.array(key & 0xFFFFFFFF)
        terms = pa.array(self.words, pa.binary()).cast(pa.string()).take(word)
        none = np.zeros(len(self.groups), np.int64)
        out = pa.RecordBatch.from_arrays(
            [pa.concat_arrays([langs.take(group), langs]),
             pa.concat_arrays([sources.take(group), sources]),
             pa.concat_arrays([terms, pa.nulls(len(none), pa.string())]),
             pa.array(np.concatenate((count, none))), pa.array(np.concatenate((docs, none)))],
            ["lang", "source", "term", "n", "docs"])
        self._clear()
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for batch in batches:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        group = np.array([tally.groups.setdefault(p, len(tally.groups)) for p in pairs], np.int64)
        view, offsets = utf8(batch.column("text"))
        for words in words_in(view, offsets, LETTERS, lower=True):
            tally.add(words, group[words.lo:words.hi])
            if tally.size > 4 * HELD:
                tally.merge()
            if tally.size > HELD or len(tally.words) > HELD:
                yield tally.rows()
    yield tally.rows()


# -- shares --------------------------------------------------------------------

def share(n: str, total: str, kept: str) -> Column:
    """``1 + floor(10**9 * (n + 5) / (total + 5 * kept))`` of whole-number columns.

    A long division of three digits to the base 1,000, so that no step leaves 64
    bits below 9 * 10**15 places.
    """
    by, rest, digits = f"({total} + {EXTRA} * {kept})", f"({n} + {EXTRA})", []
    for _ in range(3):
        digits.append(f"({rest} * 1000L div {by})")
        rest = f"({rest} * 1000L % {by})"
    return F.expr(f"1L + {digits[0]} * 1000000L + {digits[1]} * 1000L + {digits[2]}")


@dataclass(frozen=True)
class Counts:
    """What one pass over the documents leaves, written out.

    ``kept``: lang, source, term, n and lang_n of each kept term of a group.
    ``groups``: lang, source, total, lang_total, v (number of kept terms) and zero,
    the share of a term the group lacks.
    """
    kept: DataFrame
    groups: DataFrame
    n_groups: int

    def with_groups(self, df: DataFrame) -> DataFrame:
        """The rows with the columns of their group."""
        own = F.broadcast(self.groups) if self.n_groups <= BROADCAST_GROUPS else self.groups
        return df.join(own, ["lang", "source"])


def count_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, folder: str | None = None,
                lang_col: str = "lang", source_col: str = "source",
                text_col: str = "text") -> Counts:
    """Count the kept terms of every group.  Runs jobs."""
    folder = folder or work_folder(docs.sparkSession)
    text_batches()
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = settle(
        rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        folder)
    some = counted.where("term is not null")
    whole = (some.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs"))
             .where(F.col("in_docs") >= least_docs).drop("in_docs"))
    kept = settle(some.drop("docs").join(whole, ["lang", "term"]), folder)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = (kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n"))
             .groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v")))
    groups = (counted.where("term is null").select("lang", "source").distinct()
              .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "lang_total", "v"])
              .withColumn("zero", F.when(F.col("v") > 0, share("0L", "total", "v"))))
    groups = settle(groups, folder)
    return Counts(kept, groups, groups.count())


# -- audits --------------------------------------------------------------------

def terms(counts: Counts, top: int = TOP, broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """``(lang, source, term, value, rank)``: the ``top`` terms of each group by ``p - q``,
    ties in UTF-8 order.  Runs a job."""
    cells = (counts.kept.groupBy("lang", "source", "n", "lang_n")
             .agg(F.count(F.lit(1)).alias("many")))
    cells = (counts.with_groups(cells)
             .withColumn("value", share("n", "total", "v") - share("lang_n", "lang_total", "v"))
             .where("value > 0").select("lang", "source", "n", "lang_n", "many", "value"))
    cells = settle(cells)
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Each value holds a term at least, so values beyond the first ``top`` do not matter.
    values = (cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
              .withColumn("nth", F.row_number().over(falling)).where(F.col("nth") <= top)
              .withColumn("before", F.sum("many").over(
                  falling.rowsBetween(Window.unboundedPreceding, -1)))
              .na.fill(0, ["before"]).where(F.col("before") < top)
              .select("lang", "source", "value", "before"))
    chosen = settle(cells.drop("many").join(values, ["lang", "source", "value"]))
    on = ["lang", "source", "n", "lang_n"]
    if chosen.count() <= broadcast_cells:
        rows = counts.kept.join(F.broadcast(chosen), on)
    else:
        # A cell may hold a large part of all terms, so each is joined in several tasks.
        salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt")
        copies = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                F.lit(SALTS - 1).cast("bigint"))))
        rows = counts.kept.select("*", salt).join(copies, [*on, "salt"])
    alike = Window.partitionBy("lang", "source", "value").orderBy("term")
    return (rows.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= top)
            .withColumn("rank", (F.col("before") + F.col("nth")).cast("int"))
            .where(F.col("rank") <= top)
            .select("lang", "source", "term", "value", "rank"))


def _differences(key, kept: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of differences between all sources of a language over a chunk of its terms."""
    order = np.argsort(np.array(groups["source"].to_pylist(), object))
    names = groups["source"].take(pa.array(order)).combine_chunks()
    zero = groups["zero"].to_numpy()[order]
    place = {name: k for k, name in enumerate(names.to_pylist())}
    source = np.array([place[s] for s in kept["source"].to_pylist()], np.int64)
    _, term = np.unique(kept["term"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    by_term = np.argsort(term, kind="stable")
    term, source, p = term[by_term], source[by_term], kept["p"].to_numpy()[by_term]
    sums = np.zeros((len(zero), len(zero)), np.int64)
    many, step = (int(term[-1]) + 1 if len(term) else 0), max(1, BLOCK_CELLS // max(1, len(zero)))
    for lo in range(0, many, step):
        a, b = np.searchsorted(term, (lo, lo + step))
        # One row per term; a source without it has the share of a count of zero.
        block = np.tile(zero, (min(step, many - lo), 1))
        block[term[a:b] - lo, source[a:b]] = p[a:b]
        for k in range(len(zero)):
            sums[k] += np.abs(block - block[:, k:k + 1]).sum(axis=0)
    one, other = np.nonzero(~np.eye(len(zero), dtype=bool))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(one), pa.string()),
                     "source": names.take(pa.array(one)), "item": names.take(pa.array(other)),
                     "value": sums[one, other]})


def pairs(counts: Counts, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(lang, source, item, value, rank)``: every other source of each group's language
    by the sum of ``abs(p - q)``, ties in UTF-8 order.

    The terms of a language are dealt by hash to chunks, so the work spreads however
    large a language is; a chunk gives one row per pair of sources, as the result has.
    Runs a job.
    """
    spread = max(1, -(-counts.kept.count() // chunk_rows))
    kept = (counts.with_groups(counts.kept.drop("lang_n"))
            .select("lang", "source", "term", share("n", "total", "v").alias("p"),
                    F.pmod(F.xxhash64("term"), F.lit(spread)).alias("chunk")))
    copies = counts.groups.where("v > 0").select(
        "lang", "source", "zero",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))).alias("chunk"))
    sums = (kept.groupBy("lang", "chunk").cogroup(copies.groupBy("lang", "chunk"))
            .applyInArrow(_differences, "lang string, source string, item string, value bigint")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    groups = counts.groups.select("lang", "source")
    others = groups.withColumnRenamed("source", "item")
    every = groups.join(others, "lang").where("source != item")
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (every.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])
            .withColumn("rank", F.row_number().over(falling)))
