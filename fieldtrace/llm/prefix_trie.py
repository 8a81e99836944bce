"""Prefix trie of conversations, measured along its Euler tour.

A node is a distinct sequence of first turns.  Every node has an enter and an exit
arc; the tour enters a node, walks its children's subtrees and leaves it.  With the
place of each arc in the tour, a subtree is what lies between two arcs, and its
leaves and savings are differences of prefix sums.

* **Nodes.**  A prefix is named by its depth and 128 bits, the exclusive or of
  hashes of (position, turn).  That is a running sum, so a conversation of any
  length is cut into chunks of ``CHUNK`` turns that carry the sum of those before.
* **Arcs.**  The next sibling is found in buckets of a parent's children and then
  among the buckets, so the children of one parent spread over many tasks.
* **List ranking.**  Chains of only children are contracted first.  The rest of the
  tour is ranked by rulers: one arc in ``EVERY`` (by hash) is a ruler, every arc
  doubles its jump until it reaches one, and the list of rulers is ranked in the
  same way.  Only a list of at most ``BASE`` arcs is walked in a task.

Each table between the steps is written out.

Edge cases: turns without a conversation id take no part; null role or text count
as empty; turns that tie are ordered by role and text, and repeated rows are turns
of their own.  Texts are hashed and counted whole.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.timeline import row_sequence
from .frames import settle, work_folder

CHUNK = 4_096
# Conversations of a family share a start: the first turns of the one divisible by this.
FAMILY = 20
SHARED = 4
# One arc in so many is a ruler; lists up to BASE are walked.
EVERY = 16
BASE = 16_384
_KEY = ["depth", "k1", "k2"]


# -- conversations -------------------------------------------------------------

def read_turns(turns: DataFrame, folder: str, conv_col: str = "conv_id", turn_col: str = "turn",
               role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, pos, a, b, words)``: turns from 1, two hashes of role and text, and words."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = row_sequence(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text"], "pos")
    return settle(placed.select(
        "conv", "pos", F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")), folder)


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: rows for :func:`prefixes`, and their lengths."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("length"))
    rows = turns.select("conv", "pos", "a", "b", "words")
    return rows, convs


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``h`` turns are those of their family's first one.

    ``h`` is the crc32 of the decimal id, modulo ``SHARED``.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    base = F.col("conv") - F.col("conv") % FAMILY
    firsts = sizes.select(F.col("conv").alias("base"), F.col("n").alias("have"))
    convs = (sizes.withColumn("h", h).withColumn("base", base).join(firsts, "base", "left")
             .withColumn("taken", F.least("h", F.coalesce("have", F.lit(0))))
             .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    chunk = F.floor((F.col("pos") - 1) / CHUNK)
    spread = convs.select("conv", "h", "taken", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    own = (turns.withColumn("chunk", chunk).join(spread, ["conv", "chunk"]).where("pos > h")
           .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "words"))
    start = (turns.where(F.col("pos") < SHARED).withColumnRenamed("conv", "base")
             .join(convs.select("conv", "base", "h"), "base").where("pos <= h")
             .select("conv", "pos", "a", "b", "words"))
    return own.unionByName(start), convs.select("conv", "length")


def prefixes(rows: DataFrame, folder: str) -> DataFrame:
    """``(conv, depth, k1, k2, q1, q2, words)``: the prefix that ends with each turn and,
    as ``q``, the one before it."""
    rows = rows.select("conv", F.col("pos").cast("int").alias("depth"), "words",
                       F.xxhash64("pos", "a").alias("x1"), F.xxhash64("pos", "b").alias("x2"),
                       F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"))
    # Rows beyond the first chunk and what the first ones of the same conversations hold.
    many = rows.where("chunk > 0").select("conv").distinct()
    earlier = (Window.partitionBy("conv").orderBy("chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    sums = (rows.groupBy("conv", "chunk").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
            .join(many, "conv", "left_semi")
            .select("conv", "chunk", F.bit_xor("s1").over(earlier).alias("c1"),
                    F.bit_xor("s2").over(earlier).alias("c2")))
    upto = (Window.partitionBy("conv", "chunk").orderBy("depth")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def running(n):
        return F.bit_xor(f"x{n}").over(upto).bitwiseXOR(F.coalesce(f"c{n}", F.lit(0)))

    found = (rows.join(sums, ["conv", "chunk"], "left")
             .withColumn("k1", running(1)).withColumn("k2", running(2)))
    return settle(found.select("conv", *_KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("q1"),
                               F.col("k2").bitwiseXOR(F.col("x2")).alias("q2"), "words"), folder)


# -- the tree ------------------------------------------------------------------

def tree(steps: DataFrame, convs: DataFrame, folder: str) -> DataFrame:
    """One row per node: ``conv`` (smallest member), ``depth``, its hash, ``n_convs``, ``words``
    of the last turn, ``parent`` and ``next`` (sibling) and ``first`` (child) by their ``conv``,
    and ``n_children``."""
    zero = F.lit(0).cast("bigint")
    root = (convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
            .where("n_convs > 0")
            .select(F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv", "n_convs",
                    zero.alias("words"), zero.alias("q1"), zero.alias("q2")))
    below = steps.groupBy(*_KEY).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    nodes = settle(root.unionByName(below), folder)
    # Siblings follow each other by bucket, then by conversation.
    buckets = max(1, math.isqrt(nodes.count()))
    by = ["depth", "q1", "q2"]
    children = (nodes.where("depth > 0")
                .withColumn("bucket", F.pmod(F.xxhash64("conv"), F.lit(buckets))))
    siblings = Window.partitionBy(*by).orderBy("bucket")
    family = Window.partitionBy(*by)
    # At most ``buckets`` rows per parent from here on.
    heads = (children.groupBy(*by, "bucket")
             .agg(F.min("conv").alias("head"), F.count(F.lit(1)).alias("n"))
             .withColumn("beyond", F.lead("head").over(siblings))
             .withColumn("nth", F.row_number().over(siblings))
             .withColumn("n_children", F.sum("n").over(family)))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"),
                      F.col("k2").alias("q2"), F.col("conv").alias("parent"))
    heads = settle(heads.join(up, by), folder)
    parents = heads.where("nth = 1").select(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"),
        F.col("head").alias("first"), "n_children")
    inside = Window.partitionBy(*by, "bucket").orderBy("conv")
    linked = (children.join(heads.select(*by, "bucket", "beyond", "parent"), [*by, "bucket"])
              .withColumn("next", F.coalesce(F.lead("conv").over(inside), F.col("beyond"))))
    none = F.lit(None).cast("bigint")
    columns = ["conv", *_KEY, "n_convs", "words", "parent", "next"]
    every = linked.select(*columns).unionByName(
        nodes.where("depth = 0").withColumn("parent", none).withColumn("next", none).select(*columns))
    return settle(every.join(parents, _KEY, "left").na.fill(0, ["n_children"]), folder)


# -- list ranking --------------------------------------------------------------

def _walk(weights: list[str]):
    def run(table: pa.Table) -> pa.Table:
        at, after = ([tuple(a.values()) if isinstance(a, dict) else a for a in table[c].to_pylist()]
                     for c in ("at", "next"))
        place = {a: k for k, a in enumerate(at)}
        follow = [-1 if a is None else place[a] for a in after]
        begins = set(range(len(at))) - set(follow)
        order, k = [], next(iter(begins), -1)
        while k >= 0:
            order.append(k)
            k = follow[k]
        if len(order) != len(at):
            raise ValueError("the elements do not form one list")
        order = np.array(order, np.int64)
        out = {"at": table["at"].combine_chunks()}
        for w in weights:
            sums = np.empty(len(order), np.int64)
            sums[order] = np.cumsum(table[w].to_numpy()[order][::-1])[::-1]
            out[w] = sums
        return pa.table(out)
    return run


def rank(elements: DataFrame, weights: list[str], folder: str, every: int = EVERY,
         base: int = BASE, level: int = 0) -> DataFrame:
    """``(at, weights)``: for each element of one linked list (``at``, ``next``) the sums of
    the weights from it to the end.  ``next`` of the last is null.  Runs jobs."""
    now = settle(elements.select("at", "next", *weights), folder)
    if now.count() <= base:
        schema = ", ".join([f"at {now.schema['at'].dataType.simpleString()}",
                            *[f"{w} bigint" for w in weights]])
        return settle(now.groupBy(F.lit("all").alias("list")).applyInArrow(_walk(weights), schema), folder)

    def ruler(column):
        return F.pmod(F.xxhash64(F.lit(level), column), F.lit(every)) == 0

    moving = F.col("next").isNotNull() & ~ruler("next")
    while not now.where(moving).isEmpty():
        ahead = now.select(F.col("at").alias("next"), F.col("next").alias("far"),
                           *[F.col(w).alias(f"more_{w}") for w in weights])
        moved = now.where(moving).join(ahead, "next").select(
            "at", F.col("far").alias("next"), *[(F.col(w) + F.col(f"more_{w}")).alias(w) for w in weights])
        # Jumps double, so the distance to a ruler halves.
        now = settle(moved.unionByName(now.where(~moving)), folder)
    rulers = rank(now.where(ruler("at")), weights, folder, every, base, level + 1)
    rest = rulers.select(F.col("at").alias("next"), *[F.col(w).alias(f"rest_{w}") for w in weights])
    return settle(now.join(rest, "next", "left").select("at", *[
        (F.col(w) + F.coalesce(f"rest_{w}", F.lit(0))).alias(w) for w in weights]), folder)


def _arc(kind: int, conv, depth):
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.struct(F.lit(kind).alias("kind"), F.col(conv).alias("conv"),
                    depth.cast("int").alias("depth"))


def measure(nodes: DataFrame, folder: str, every: int = EVERY, base: int = BASE) -> DataFrame:
    """The nodes of :func:`tree` with ``enter`` and ``exit`` (places in the tour, from 0),
    ``n_leaves`` and ``saved`` of their subtrees."""
    path = Window.partitionBy("conv", F.floor(F.col("depth") / CHUNK)).orderBy("depth")
    joined = ((F.lag("depth").over(path) == F.col("depth") - 1)
              & (F.lag("n_children").over(path) == 1))
    upto = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (nodes.withColumn("saving", (F.col("n_convs") - 1) * F.col("words"))
            .withColumn("starts", ~F.coalesce(joined, F.lit(False)))
            .withColumn("top", F.max(F.when(F.col("starts"), F.col("depth"))).over(upto))
            .withColumn("sum", F.sum("saving").over(upto)))
    # What the chain's nodes above this one save.
    chain = Window.partitionBy("conv", F.floor(F.col("depth") / CHUNK), "top").orderBy("depth")
    rows = settle(rows.withColumn(
        "above", F.col("sum") - F.col("saving") - F.first(F.col("sum") - F.col("saving")).over(chain))
        .drop("sum", "starts"), folder)
    ends = F.struct("depth", "n_children", "first")
    chains = settle(rows.groupBy("conv", "top").agg(
        F.max(ends).alias("low"), F.sum("saving").alias("saving"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct("depth", "parent", "next")).alias("high"))
        .select("conv", "top", F.col("low.depth").alias("bottom"), F.col("low.first").alias("first"),
                "n", "saving", F.col("high.parent").alias("parent"), F.col("high.next").alias("next")),
        folder)
    leaf = F.col("first").isNull()
    zero = F.lit(0).cast("bigint")
    enters = chains.select(
        _arc(0, "conv", "top").alias("at"),
        F.when(leaf, _arc(1, "conv", "bottom")).otherwise(
            _arc(0, "first", F.col("bottom") + 1)).alias("next"),
        F.col("n").alias("arcs"), leaf.cast("bigint").alias("leaves"), F.col("saving").alias("saved"))
    exits = chains.select(
        _arc(1, "conv", "bottom").alias("at"),
        F.when(F.col("next").isNotNull(), _arc(0, "next", "top"))
        .when(F.col("parent").isNotNull(), _arc(1, "parent", F.col("top") - 1)).alias("next"),
        F.col("n").alias("arcs"), zero.alias("leaves"), zero.alias("saved"))
    sums = rank(enters.unionByName(exits), ["arcs", "leaves", "saved"], folder, every, base)

    def side(kind, depth, name):
        return sums.where(F.col("at.kind") == kind).select(
            F.col("at.conv").alias("conv"), F.col("at.depth").alias(depth),
            *[F.col(w).alias(f"{name}_{w}") for w in ("arcs", "leaves", "saved")])

    spans = (chains.select("conv", "top", "bottom").join(side(0, "top", "in"), ["conv", "top"])
             .join(side(1, "bottom", "out"), ["conv", "bottom"]))
    arcs = 2 * nodes.count()
    return rows.join(spans, ["conv", "top"]).select(
        "conv", *_KEY, "parent", "n_convs", "n_children", "words",
        (F.lit(arcs) - F.col("in_arcs") + F.col("depth") - F.col("top")).alias("enter"),
        (F.lit(arcs) - F.col("out_arcs") + F.col("bottom") - F.col("depth")).alias("exit"),
        (F.col("in_leaves") - F.col("out_leaves")).alias("n_leaves"),
        (F.col("in_saved") - F.col("out_saved") - F.col("above")).alias("saved"))


def endings(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """``(depth, k1, k2, digest)``: SHA-256 of the sorted ids of the conversations that end
    at a node, in decimal and joined by commas.

    Ids are joined in chunks of neighbouring ids; a task then reads the chunks of a
    node in order and holds one of them at a time, so any number may end there.
    """
    last = convs.select("conv", F.col("length").cast("int").alias("depth"))
    zero = F.lit(0).cast("bigint")
    at = steps.select("conv", *_KEY).join(last.where("depth > 0"), ["conv", "depth"]).unionByName(
        last.where("depth = 0").select("conv", "depth", zero.alias("k1"), zero.alias("k2")))
    chunks = (at.groupBy(*_KEY, F.shiftright("conv", 12).alias("chunk"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")),
                                            lambda c: c.cast("string")), ",").alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.string())],
                [*_KEY, "digest"])

        for batch in batches:
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")]):
                if own == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield out()
                done.clear()
        if key is not None:
            done.append((*key, sha.hexdigest()))
            yield out()

    return (chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk")
            .select(*_KEY, "ids")
            .mapInArrow(digest, "depth int, k1 bigint, k2 bigint, digest string"))


def trie(turns: DataFrame, families: bool = True, every: int = EVERY, base: int = BASE,
         folder: str | None = None, **columns: str) -> DataFrame:
    """One row per node: ``conv``, ``depth``, ``parent``, ``n_convs``, ``n_children``, ``words``,
    ``enter``, ``exit``, ``n_leaves``, ``saved`` and ``digest`` (of the ids that end there).

    ``families`` first rebuilds the conversations (:func:`rebuilt`).  Runs jobs.
    """
    folder = folder or work_folder(turns.sparkSession)
    rows, convs = (rebuilt if families else whole)(read_turns(turns, folder, **columns))
    convs = settle(convs, folder)
    steps = prefixes(rows, folder)
    found = measure(tree(steps, convs, folder), folder, every, base)
    nothing = hashlib.sha256().hexdigest()
    return (found.join(endings(steps, convs), _KEY, "left").na.fill(nothing, ["digest"])
            .drop("k1", "k2"))
