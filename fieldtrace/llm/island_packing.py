"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

:func:`cut` encodes whole texts and cuts those longer than a sequence: all pieces
but the first are whole sequences.  :func:`place` gives the other pieces places in
as few sequences as it can.

The genes are whole sequences.  A crossover injects a share of one parent's well
filled sequences into the other, drops the sequences there that hold a piece
twice, and deals the displaced pieces to the fullest sequence that has room
(longest first).  Fitness is the mean square fill.

Pieces are dealt by hash to districts of about ``DISTRICT`` pieces, which hold a
bounded share of memory, and each district is evolved on several islands: rows of a
table that carry a population each.  After every epoch the best packing of an
island migrates to the next one.  Then the least filled sequences of all districts
are pooled, dealt whole to districts anew and evolved with the packing they have as
one of the population, which can only save sequences; this ends when the pool fits
one district.  No step holds more than a district.

Each table between the steps is written out, so lost executors redo their own step;
random numbers follow from district, island and epoch.

Edge cases: a null text counts as empty and is its end id alone; rows are told apart
by their place in the written table, so ids may be null or repeat.  An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bitpacked_tokens import END_ID, encoder, with_end
from .frames import settle, text_batches, work_folder

CAPACITY = 2048
# Pieces of a district (about), its islands, packings on an island.
DISTRICT = 16_000
ISLANDS = 3
POPULATION = 4
EPOCHS = 2
# Crossovers on an island in an epoch.
CROSSOVERS = 8
# Share of the sequences that a crossover injects, and that are pooled again.
INJECTED = 0.3
POOLED = 0.05


# -- pieces --------------------------------------------------------------------

def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, folder: str | None = None,
        id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(row, id, piece, start, length, ids)``: the ids of all documents, each with
    ``end_id`` behind, in pieces of at most ``capacity`` ids.

    ``row`` names the piece, ``start`` counts its document's ids before it, ``ids`` are
    little-endian unsigned 32-bit numbers.  Written out; runs a job.
    """
    text_batches()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, at = batch.column("id"), 0
            for ids, n in enc.encode(batch.column("text")):
                ids, n = with_end(ids, n, end_id)
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                short = (n - (many - 1) * capacity)[doc]
                length = np.where(piece == 0, short, capacity)
                start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
                ends = np.concatenate(([0], np.cumsum(length))) * 4
                data = pa.Array.from_buffers(
                    pa.large_binary(), len(doc),
                    [None, pa.py_buffer(ends.astype(np.int64).tobytes()),
                     pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(doc))), names.take(pa.array(at + doc)),
                     pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length.astype(np.int32)), data],
                    ["row", "id", "piece", "start", "length", "ids"])
                row, at = row + len(doc), at + len(n)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return settle(rows.mapInArrow(
        pieces, "row bigint, id bigint, piece int, start bigint, length int, ids binary"), folder)


# -- one district --------------------------------------------------------------

def best_fit(lengths: np.ndarray, order: np.ndarray, place: np.ndarray, fill: list[int],
             capacity: int) -> None:
    """Put the pieces of ``order`` where the least room is left that holds them.

    ``place`` gets their sequences; ``fill`` is what each one holds, and grows.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k, held in enumerate(fill):
        room[capacity - held].append(k)
    # Bit r is set where some sequence has room for exactly r more ids.
    some = sum(1 << r for r, held in enumerate(room) if held)
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = some >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, k = capacity, len(fill)
            fill.append(0)
        place[item] = k
        fill[k] += size
        room[r - size].append(k)
        some |= 1 << (r - size)


def packed(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Sequences of the pieces, dealt by best fit in this order."""
    place = np.zeros(len(lengths), np.int32)
    best_fit(lengths, order, place, [], capacity)
    return place


def fills(lengths: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.bincount(place, lengths).astype(np.int64)


def fitness(lengths: np.ndarray, place: np.ndarray, capacity: int) -> float:
    """The mean square fill of the sequences."""
    return float(np.square(fills(lengths, place) / capacity).mean())


def crossover(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int,
              rng: np.random.Generator, injected: float = INJECTED) -> np.ndarray:
    """A child: well filled sequences of ``other`` whole, those of ``one`` that share no
    piece with them, and best fit for the rest."""
    fill = fills(lengths, other)
    # The fuller a sequence, the likelier it is injected.
    odds = rng.random(len(fill)) ** (1 / np.maximum((fill / capacity) ** 8, 1e-9))
    many = max(1, int(injected * len(fill)))
    gene = np.zeros(len(fill), bool)
    gene[np.argpartition(-odds, many - 1)[:many]] = True
    inside = gene[other]
    hit = np.zeros(int(one.max()) + 1, bool)
    hit[one[inside]] = True
    stay = ~inside & ~hit[one]
    child = np.zeros(len(lengths), np.int32)
    number = np.cumsum(gene) - 1
    child[inside] = number[other[inside]]
    held, where = np.unique(one[stay], return_inverse=True)
    child[stay] = many + where
    full = np.bincount(child[inside | stay], lengths[inside | stay], many + len(held))
    loose = np.flatnonzero(~(inside | stay))
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    best_fit(lengths, order, child, full.astype(np.int64).tolist(), capacity)
    return child


def evolve(lengths: np.ndarray, members: list[np.ndarray], capacity: int,
           rng: np.random.Generator) -> list[np.ndarray]:
    """One epoch on an island; the population comes back best first."""
    least = -(-int(lengths.sum()) // capacity)
    noise = 0.0 if not members else 0.1
    while len(members) < POPULATION:
        keys = lengths * (1 + noise * rng.standard_normal(len(lengths)))
        members.append(packed(lengths, np.argsort(-keys, kind="stable"), capacity))
        noise = 0.1
    scored = sorted(((fitness(lengths, m, capacity), k, m) for k, m in enumerate(members)), reverse=True)
    scored = scored[:POPULATION]
    for step in range(CROSSOVERS):
        if int(scored[0][2].max()) + 1 == least:
            break
        # The better one of two drawn, and a partner.
        a = int(min(rng.integers(0, POPULATION, 2)))
        b = int((a + rng.integers(1, POPULATION)) % POPULATION)
        child = crossover(lengths, scored[a][2], scored[b][2], capacity, rng)
        value = fitness(lengths, child, capacity)
        if value > scored[-1][0] and all(value != s[0] for s in scored):
            scored[-1] = (value, -1 - step, child)
            scored.sort(key=lambda s: (-s[0], s[1]))
    return [m for _, _, m in scored]


# -- Spark ---------------------------------------------------------------------

_STATE = ("district bigint, island int, lengths array<int>, members array<array<int>>, "
          "score double, used int")


def _epoch(capacity: int, epoch: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                district, island = (batch.column(c)[row].as_py() for c in ("district", "island"))
                lengths = batch.column("lengths")[row].values.to_numpy()
                members = [m.values.to_numpy() for m in batch.column("members")[row]]
                rng = np.random.default_rng((seed, epoch, island, district))
                found = evolve(lengths, members, capacity, rng)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([district]), pa.array([island], pa.int32()),
                     pa.array([lengths], pa.list_(pa.int32())),
                     pa.array([found], pa.list_(pa.list_(pa.int32()))),
                     pa.array([fitness(lengths, found[0], capacity)]),
                     pa.array([int(found[0].max()) + 1], pa.int32())],
                    ["district", "island", "lengths", "members", "score", "used"])
    return run


def _finish(capacity: int, pooled: float):
    """Rows of a district's best packing; its least filled sequences are marked loose."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, lengths, place = (batch.column(c)[k].values.to_numpy()
                                        for c in ("rows", "lengths", "best"))
                full = fills(lengths, place)
                loose = np.zeros(len(full), bool)
                # Half of them at most, so that the pool shrinks.
                many = min(int(np.ceil(pooled * len(full))), len(full) // 2)
                loose[np.argsort(full, kind="stable")[:many]] = True
                loose &= full < capacity
                order = np.lexsort((rows, place))
                upto = np.cumsum(lengths[order])
                begin = np.flatnonzero(np.diff(place[order], prepend=-1))
                offset = upto - lengths[order]
                offset -= np.repeat(offset[begin], np.diff(np.append(begin, len(order))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[order]), pa.array(lengths[order].astype(np.int32)),
                     pa.array(np.full(len(order), batch.column("district")[k].as_py())),
                     pa.array(place[order].astype(np.int64)), pa.array(offset.astype(np.int64)),
                     pa.array(loose[place[order]])],
                    ["row", "length", "district", "place", "offset", "loose"])
    return run


def _settled_round(items: DataFrame, count: int, size: int, number: int, capacity: int,
                   pooled: float, folder: str) -> tuple[DataFrame, int]:
    """Pack ``(row, length, group)``, groups staying together, in districts of ``size``.

    Returns the places and the number of districts.
    """
    many = max(1, -(-count // size))
    dealt = items.withColumn("district", F.pmod(F.xxhash64(F.lit(number), "group"), F.lit(many)))
    # A district is bounded by its size, up to chance.
    # Pooled pieces bring the packing that they have.
    old = F.dense_rank().over(Window.partitionBy("district").orderBy("group")) - 1
    items = dealt.select("district", F.struct(
        "row", "length", (old if number else F.lit(0)).alias("old")).alias("item"))
    held = settle(items.groupBy("district").agg(F.sort_array(F.collect_list("item")).alias("items"))
                  .select("district", F.col("items.row").alias("rows"),
                          F.col("items.length").alias("lengths"), F.col("items.old").alias("old")), folder)
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    known = F.array().cast("array<array<int>>") if number == 0 else F.array("old")
    state = held.select("district", islands, "lengths", known.alias("members"))
    for epoch in range(EPOCHS):
        if epoch:
            guests = state.select(
                "district", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                F.col("members")[0].alias("guest"))
            state = (state.join(guests, ["district", "island"])
                     .withColumn("members", F.concat("members", F.array("guest"))))
        spread = max(1, -(-many * ISLANDS // 4))
        state = settle(state.select("district", "island", "lengths", "members")
                       .repartition(spread, "district", "island")
                       .mapInArrow(_epoch(capacity, epoch, number), _STATE), folder)
    best = state.groupBy("district").agg(F.max_by(
        F.col("members")[0], F.struct(-F.col("used"), "score", "island")).alias("best"))
    found = held.drop("old").join(best, "district").mapInArrow(
        _finish(capacity, pooled if many > 1 else 0.0),
        "row bigint, length int, district bigint, place bigint, offset bigint, loose boolean")
    name = (F.lit(number) * F.lit(1 << 36) + F.col("district")) * F.lit(1 << 20) + F.col("place")
    return settle(found.withColumn("sequence_id", name), folder), many


def place(pieces: DataFrame, capacity: int = CAPACITY, district: int = DISTRICT,
          pooled: float = POOLED, folder: str | None = None) -> DataFrame:
    """``(row, sequence_id, offset)`` for pieces ``(row, length)`` of 1 to ``capacity`` ids.

    Sequences are gapless from 0.  Runs jobs.
    """
    folder = folder or work_folder(pieces.sparkSession)
    whole = (pieces.where(F.col("length") == capacity)
             .select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    items = pieces.where(F.col("length") < capacity).select("row", "length", F.col("row").alias("group"))
    done, number, count = whole, 0, items.count()
    while count:
        found, many = _settled_round(items, count, district, number, capacity, pooled, folder)
        done = done.unionByName(found.where("not loose").select("row", "sequence_id", "offset"))
        items = found.where("loose").select("row", "length", F.col("sequence_id").alias("group"))
        count = items.count() if many > 1 else 0
        number += 1
    return done


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the ids of each sequence, its pieces one after another."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (pieces.select("row", "ids").join(places, "row").groupBy("sequence_id")
            .agg(held.alias("held"))
            .select("sequence_id", F.aggregate(
                "held", F.lit(b""), lambda all_ids, h: F.concat(all_ids, h["ids"])).alias("ids")))
