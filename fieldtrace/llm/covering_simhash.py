"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint.  For a radius ``r`` each bit position gets
a vector of ``r + 1`` bits, and each non-zero vector ``v`` of that space gives a
mask: the positions whose vector has an odd product with ``v``.  Any ``r``
positions span less than the space, so some ``v`` is orthogonal to all of them
and its mask holds none of them: two fingerprints that differ in at most ``r``
bits agree under that mask.  So no linked pair is missed, with 31 tables at
radius 4, each keeping about half of the bits.

Only distinct fingerprints are looked up.  Within a table's bucket each is first
compared with the smallest of the bucket, which joins dense groups of copies by
a linear number of links.  After their components are known, only members of
different components remain to be compared: those outside a bucket's largest
component against the rest, in blocks that give component pairs, never all pairs.

Edge cases: a null text has no words; texts without words have fingerprint zero
and link like any other.  Null ids take part; a component's id is its smallest
id that is not null, or null.  Repeated rows each give a row.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from .frames import components, settle, text_batches, utf8, work_folder
from .wordbytes import NOT_BLANK, joined, words_in

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
# Members of a bucket that are compared as one block.
BLOCK = 512
# Hashes summed before 16-bit counters are widened.
_WIDEN = 32_768


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks, as signed 64-bit numbers; see the module's text."""
    size = (1 << (radius + 1)) - 1
    vectors = [i % size + 1 for i in range(bits)]
    masks = []
    for v in range(1, size + 1):
        kept = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each group of hashes the bits set in over half of them."""
    count = np.diff(first)
    some = np.flatnonzero(count)
    out = np.zeros(len(count), np.uint64)
    if not some.size:
        return out
    cuts = [np.arange(first[k], first[k + 1], _WIDEN) if count[k] > _WIDEN
            else first[k:k + 1] for k in some]
    owner = np.repeat(np.arange(some.size), [len(c) for c in cuts])
    cuts = np.concatenate(cuts)
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    half = count[some]
    lane = np.uint64(0x0001000100010001)
    for k in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lane, cuts)
        for part in range(4):
            bit = np.uint64(k + 16 * part)
            ones = np.add.reduceat((sums >> np.uint64(16 * part)) & np.uint64(0xFFFF), heads)
            out[some] |= (2 * ones > half).astype(np.uint64) << bit
    return out


def _fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    view, offsets = utf8(column)
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for w in words_in(view, offsets, NOT_BLANK, lower=True):
        text, start, end = joined(w)
        n = np.diff(w.first)
        shingles = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
        first = np.concatenate(([0], np.cumsum(shingles)))
        head = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], shingles)
        last = head + np.repeat(np.minimum(n, shingle), shingles) - 1
        hashes = np.fromiter(
            (digest(text[a:b], SEED) for a, b in zip(start[head].tolist(), end[last].tolist())),
            np.uint64, len(head))
        out[w.lo:w.hi] = _majority(hashes, first)
    return out


def fingerprint(text: str | Column, shingle: int = SHINGLE) -> Column:
    """The SimHash of a text as a bigint that holds its 64 bits."""
    text_batches()

    @arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(_fingerprints(column, shingle).view(np.int64))

    return simhash(text)


def _apart(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def linked(prints: DataFrame, radius: int = RADIUS, folder: str | None = None) -> DataFrame:
    """``(node, label)`` for distinct fingerprints ``fp`` that link to others.

    ``label`` is the smallest fingerprint that can be reached by steps of at most
    ``radius`` bits.  Complete; runs jobs.
    """
    folder = folder or work_folder(prints.sparkSession)
    tables = F.array(*[
        F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask)))
        for k, mask in enumerate(covering_masks(radius))])
    rows = prints.select("fp", F.explode(tables).alias("key"))
    shared = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("hub"))
              .where("n > 1").select("key", "hub"))
    # A hash of the masked value only brings together; distance decides.  Spark sizes
    # exploded rows as if there were one a fingerprint, so it may not choose to broadcast.
    members = settle(rows.join(shared.hint("merge"), "key"), folder)
    stars = settle(members.where((F.col("fp") != F.col("hub")) & (_apart("fp", "hub") <= radius))
                   .select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct(), folder)
    first = components(stars, folder)

    placed = settle(members.join(first, members.fp == first.node, "left").select(
        "key", "fp", F.coalesce("label", "fp").alias("comp")), folder)
    by_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (by_comp.groupBy("key")
             .agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("size"),
                  F.count(F.lit(1)).alias("comps")).where("comps > 1"))
    open_ = placed.join(mixed, "key")

    def blocks(df, name):
        salt = F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / BLOCK).cast("bigint"))
        return df.groupBy("key", salt.alias("salt")).agg(
            F.collect_list(F.struct("fp", "comp")).alias(name)).drop("salt")

    every = blocks(open_, "every")
    light = blocks(open_.where("comp != main"), "light")

    def met(a, b):
        return (a["comp"] != b["comp"]) & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= radius)

    found = F.array_distinct(F.flatten(F.transform(
        "light", lambda a: F.transform(
            F.filter("every", lambda b: met(a, b)),
            lambda b: F.struct(a["comp"].alias("a"), b["comp"].alias("b"))))))
    more = (light.join(every, "key").select(F.inline(found)).distinct())
    more = settle(more, folder)
    if more.isEmpty():
        return first
    return components(stars.union(more), folder)


def _labelled(marked: DataFrame, radius: int, folder: str) -> DataFrame:
    """``(fp, least, label)`` of the fingerprints in ``(id, fp)``: the smallest id with each,
    and the component."""
    # Partly aggregated before the shuffle.
    prints = settle(marked.groupBy("fp").agg(F.min("id").alias("least")), folder)
    groups = linked(prints.select("fp"), radius, folder)
    return prints.join(groups, prints.fp == groups.node, "left").select(
        prints.fp, "least", F.coalesce("label", prints.fp).alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``."""
    folder = work_folder(docs.sparkSession)
    marked = settle(docs.select(F.col(id_col).alias("id"),
                                fingerprint(F.col(text_col), shingle).alias("fp")), folder)
    named = _labelled(marked, radius, folder)
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = settle(named.select("fp", "label").join(smallest, "label")
                   .select("fp", "component_id"), folder)
    return marked.join(named, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row, all
    columns unchanged.

    It is the row with the smallest id (null ids last), among those with this id the
    one with the smallest fingerprint, and any one of those that agree in both.
    """
    folder = work_folder(docs.sparkSession)
    rows = settle(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                              F.col(id_col).alias("id"),
                              fingerprint(F.col(text_col), shingle).alias("fp")), folder)
    first = F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first")
    stay = (_labelled(rows.select("id", "fp"), radius, folder).groupBy("label").agg(first)
            .select(F.col("first.least").alias("first_id"), F.col("first.fp").alias("first_fp")))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("first_id"))
                     & (F.col("fp") == F.col("first_fp")), "left_semi")
    once = Window.partitionBy("id", "fp").orderBy("fp")
    return kept.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")
