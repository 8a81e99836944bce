"""Hits, items and longest matches against brute force."""

import pytest

from fieldtrace.llm import suffix_decontamination as op

from ..conftest import SMALL
from .conftest import EDGES, letter_words, text_frame

ITEMS = [(901, "zq"), (902, ""), (903, None), (904, "zq " * 12), (905, "ZQ"),
         (None, "two three four, five six"), (906, "x y"),
         (906, "one two three four five six seven eight nine ten eleven twelve")]
TEXTS = [(91_001, "zq"), (91_002, "ZQ zq zq " * 300), (91_002, "ZQ zq zq " * 300),
         (91_003, "one two three four five six seven eight nine ten eleven")]


@pytest.fixture(scope="module")
def case(spark, sample_texts):
    rows = sample_texts + EDGES + TEXTS
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").unionByName(
        spark.createDataFrame(ITEMS, "item_id long, text string"))
    items = [("" if r.item_id is None else str(r.item_id), letter_words(r.text)) for r in bench.collect()]
    return rows, text_frame(spark, rows), bench, items


def brute(rows, items):
    windows = {}
    for name, words in items:
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k:k + n]), set()).add(name)
    out = []
    for doc, text in rows:
        words = letter_words(text)
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                names = windows.get(tuple(words[k:k + n]))
                if names:
                    found |= names
                    hit |= set(range(k, k + n))
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_matches(case):
    rows, docs, bench, items = case
    want = brute(rows, items)
    got = op.matches(docs, bench).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == want
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in got)
    # Several blocks of items give the same.
    again = op.matches(docs, bench, block_bytes=2000).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in again), key=repr) == want
    clean = sorted((d for d, _, hit, _ in want if not hit), key=repr)
    for size in (op.BLOCK_BYTES, 2000):
        kept = op.remove(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == clean


def longest(rows, items):
    """The longest common run of each document that holds a whole window, by diagonals."""
    starts = {}
    for name, own in items:
        for j in range(len(own) - min(10, len(own)) + 1 if own else 0):
            starts.setdefault(tuple(own[j:j + min(10, len(own))]), []).append((name, own, j))
    out = []
    for doc, text in rows:
        words, best = letter_words(text), None
        for n in {len(k) for k in starts}:
            for k in range(len(words) - n + 1):
                for name, own, j in starts.get(tuple(words[k:k + n]), ()):
                    size = n
                    while k + size < len(words) and j + size < len(own) and words[k + size] == own[j + size]:
                        size += 1
                    found = (-size, k, name, j)
                    best = found if best is None or found < best else best
        out.append((doc, best))
    return sorted(out, key=repr)


def test_longest_of_each_document(spark, case):
    rows, docs, bench, items = case
    passage = " ".join(f"v{k % 40}" for k in range(90))
    words = passage.split()
    more = [(92_001, " ".join(words[5:70]) + " gap " + passage), (92_002, "a b " + " ".join(words[30:41])),
            (92_003, passage * 2), (92_004, " ".join(words[:25] + ["x"] + words[25:])), (92_004, passage)]
    tests = [(950, passage), (951, " ".join(words[20:60])), (951, passage), (952, "v1 v2 v3"), (950, passage)]
    rows, docs = rows + more, docs.unionByName(text_frame(spark, more))
    bench = bench.unionByName(spark.createDataFrame(tests, "item_id long, text string"))
    want = longest(rows, items + [(str(n), letter_words(t)) for n, t in tests])
    for size in (op.BLOCK_BYTES, 2000):
        got = [(r.id, r.longest and (-r.longest.length, r.longest.start, r.longest["item"], r.longest.item_start))
               for r in op.matches(docs, bench, block_bytes=size).collect()]
        assert sorted(got, key=repr) == want


def test_longest_matches(case):
    rows, docs, bench, items = case
    words = {d: letter_words(t) for d, t in rows}
    got = op.longest_matches(docs.where("doc_id IS NOT NULL"), bench).collect()
    texts = {}
    for name, own in items:
        texts.setdefault(name, []).append(own)
    assert got
    for r in got:
        span = words[r.id][r.start:r.start + r.length]
        assert any(own[r.item_start:r.item_start + r.length] == span for own in texts[r.item])


def test_empty(spark, case):
    _, docs, bench, _ = case
    assert op.matches(docs.limit(0), bench).count() == 0
    none = op.matches(docs, bench.limit(0)).where("n_hit > 0 OR size(items) > 0")
    assert none.count() == 0
    assert op.remove(docs, bench.limit(0)).count() == docs.count()
