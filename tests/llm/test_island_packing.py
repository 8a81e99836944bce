"""Packing: valid, gapless, close to the bound, and the same ids as the library gives."""

import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtrace.llm import island_packing as op

from .conftest import EDGES, text_frame

FILE = public_tokenizers.path("byte_bpe_50k.json")


def rng(seed=0):
    return np.random.default_rng(seed)


def valid(lengths, place, capacity):
    assert len(place) == len(lengths) and set(place.tolist()) == set(range(int(place.max()) + 1))
    assert op.fills(lengths, place).max() <= capacity


def fewest(lengths, capacity):
    """Fewest sequences, by trying all ways."""
    best = len(lengths)

    def go(k, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if k == len(lengths):
            best = len(fill)
            return
        for at in range(len(fill)):
            if fill[at] + lengths[k] <= capacity and fill[at] not in fill[:at]:
                fill[at] += lengths[k]
                go(k + 1, fill)
                fill[at] -= lengths[k]
        go(k + 1, fill + [lengths[k]])

    go(0, [])
    return best


def test_best_fit_takes_the_least_room():
    place, fill = np.zeros(4, np.int32), [50, 90, 70]
    op.best_fit(np.array([25, 10, 96, 5]), np.arange(4), place, fill, 100)
    assert place.tolist() == [2, 1, 3, 2] and fill == [50, 100, 100, 96]


@pytest.mark.parametrize("seed", range(6))
def test_crossover_keeps_every_piece_once(seed):
    draw = rng(seed)
    lengths = draw.integers(1, 100, 300)
    one, other = (op.packed(lengths, draw.permutation(300), 100) for _ in range(2))
    child = op.crossover(lengths, one, other, 100, draw)
    valid(lengths, child, 100)
    # The injected sequences come whole from the other parent.
    whole = {frozenset(np.flatnonzero(other == k).tolist()) for k in range(other.max() + 1)}
    got = [frozenset(np.flatnonzero(child == k).tolist()) for k in range(child.max() + 1)]
    assert sum(g in whole for g in got) >= int(op.INJECTED * (other.max() + 1))


@pytest.mark.parametrize("seed", range(8))
def test_evolved_packings_against_all_ways(seed):
    draw = rng(seed)
    lengths = draw.integers(15, 60, 10)
    best = op.evolve(lengths, [], 100, draw)[0]
    valid(lengths, best, 100)
    assert best.max() + 1 <= fewest(lengths.tolist(), 100) + 1


def test_evolving_beats_best_fit_decreasing():
    """Triplets that fill sequences exactly: the first packing wastes some, the last fewer."""
    draw = rng(1)
    parts = [(a, b, 1000 - a - b) for a, b in draw.integers(260, 370, (150, 2)).tolist()]
    lengths = np.array(list(itertools.chain(*parts)))
    first = op.packed(lengths, np.argsort(-lengths), 1000)
    members = [first]
    for epoch in range(12):
        members = op.evolve(lengths, members, 1000, rng(epoch))
    valid(lengths, members[0], 1000)
    assert members[0].max() < first.max()


def placed(spark, lengths, **options):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "row long, length int")
    rows = df.join(op.place(df, **options), "row").collect()
    assert sorted(r.row for r in rows) == list(range(len(lengths)))
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= options.get("capacity", op.CAPACITY)
    return len(held)


@pytest.mark.parametrize("district", [20, 200])
def test_pooling_saves_sequences(spark, district):
    """The least filled sequences of all districts, packed again, take fewer than before."""
    lengths = rng(4).integers(1, 101, 1_500).tolist()
    apart = placed(spark, lengths, capacity=100, district=district, pooled=0.0)
    assert placed(spark, lengths, capacity=100, district=district) < apart


def test_one_district_comes_close_to_the_bound(spark):
    lengths = rng(4).integers(1, 101, 1_500).tolist()
    assert placed(spark, lengths, capacity=100) <= -(-sum(lengths) // 100) * 1.01


def test_ties_and_extremes(spark):
    assert placed(spark, [2048] * 5) == 5
    assert placed(spark, [1] * 3_000) == 2
    assert placed(spark, [1025] * 40, district=7) == 40
    assert placed(spark, [1024] * 41, district=7) == 21
    assert op.place(spark.createDataFrame([], "row long, length int")).count() == 0


def test_documents_round_trip(spark, sample_texts):
    rows = sample_texts[:80] + EDGES + [(1, "twice"), (1, "twice"), (None, "no name here")]
    pieces = op.cut(text_frame(spark, rows).repartition(3), FILE, capacity=64)
    tokenizer, want = Tokenizer.from_file(FILE), []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 64 + 1
        starts = [0, *range(first, len(ids), 64)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((doc, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()))
    got = [(r.id, r.piece, r.start, r.length, bytes(r.ids)) for r in pieces.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    places = op.place(pieces.select("row", "length"), capacity=64, district=50)
    whole = {r.sequence_id: bytes(r.ids) for r in op.sequences(pieces, places).collect()}
    for r in pieces.join(places, "row").select("length", "ids", "sequence_id", "offset").collect():
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(map(len, whole.values())) == 4 * pieces.agg(F.sum("length")).first()[0]


def test_empty(spark):
    pieces = op.cut(text_frame(spark, []), FILE)
    assert pieces.count() == 0 and op.place(pieces.select("row", "length")).count() == 0
