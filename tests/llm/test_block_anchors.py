"""Removed words against brute force."""

import random

import pytest

from fieldtrace.llm import block_anchors as op

from .conftest import EDGES, blank_words, text_frame, word_salad


def brute(rows, window):
    first = {}
    for doc, text in rows:
        words = blank_words(text)
        for k in range(len(words) - window + 1 if doc is not None else 0):
            key = tuple(words[k:k + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = blank_words(text)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[k:k + window])] < doc:
                gone[k:k + window] = [True] * window
        out.append((doc, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in rows)
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


def passages():
    shared = word_salad(3, 73)
    words = shared.split()
    return [(91_001, shared), (None, shared), (91_002, "x " * 7 + shared + " y"), (91_003, "a " * 200),
            (91_004, "a " * 120 + "b"), (91_005, shared + " " + shared), (91_001, "q " + shared),
            (91_006, " ".join(words[3:52])), (91_007, " ".join(words[3:53])),
            (91_008, word_salad(4, 30) + "\n" + " ".join(words[20:72]) + "\t é")]


def test_removed_words(spark, sample_texts):
    rows = sample_texts + EDGES + passages()
    docs = text_frame(spark, rows)
    assert found(op.remove_repeats(docs)) == brute(rows, op.WINDOW)


@pytest.mark.parametrize("window", [2, 7])
def test_other_windows_and_many_groups(spark, window):
    rng = random.Random(window)
    rows = [(k // 2, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for k in range(60)]
    got = op.remove_repeats(text_frame(spark, rows), window=window, group_bytes=60, part_bytes=90)
    assert found(got) == brute(rows, window)


def test_repeated_rows_spread(spark):
    """Rows that repeat an id and a text are one document, in whichever groups they lie."""
    hot, rng = word_salad(11, 60), random.Random(5)
    rows = [(7, hot)] * 40 + [(k, hot if k % 3 == 0 else word_salad(k, 55)) for k in range(20)] + [(None, hot)] * 5
    rng.shuffle(rows)
    got = op.remove_repeats(text_frame(spark, rows).repartition(4), group_bytes=500, part_bytes=900)
    assert found(got) == brute(rows, op.WINDOW)


def test_every_alignment_meets_an_anchor(spark):
    text = word_salad(9, 50)
    rows = [(shift, word_salad(100 + shift, shift) + " " + text + " " + word_salad(200 + shift, 60))
            for shift in range(30)]
    got = {r.id: r.n_removed for r in op.remove_repeats(text_frame(spark, rows)).collect()}
    assert got == {shift: 50 * (shift > 0) for shift in range(30)}


def test_empty(spark):
    assert op.remove_repeats(text_frame(spark, [])).count() == 0
