"""The trie and its tour against a plain recomputation."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import prefix_trie as op
from fieldtrace.llm.queries import ORACLES

from .conftest import blank_words, with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, SCHEMA))


def conversations(rows, families):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    if not families:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows, families=True):
    talks = conversations(rows, families)
    nodes = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        words = len(blank_words(path[-1][1].decode())) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = sum(saved[p] for p in children[path]) + (len(nodes[path]) - 1) * words
    out = set()
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(talks[c]) == len(path))))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                 len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def sample(seed=0, n=150):
    """Many equal starts, equal conversations, one long one, ties, nulls, absent first ones."""
    rng, rows = random.Random(seed), []
    for c in [*range(0, 2 * n, 2), *range(-30, 0, 7), 10 ** 12 + 1, 10 ** 12 + 20]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "user", None, ""]),
                         rng.choice(["hello", "hello there", "a b  c\n", "", None, "Ünï 文"])))
    rows += [(41, k, "user", f"step {k}") for k in range(90)]
    rows += [(c, k, "x", "same turn") for c in range(1001, 1400, 20) for k in range(4)]
    rows += [(7, 1, "user", "twice")] * 3 + [(None, 1, "user", "nobody's")] * 2
    rng.shuffle(rows)
    return rows


def got(spark, rows, **options):
    found = op.trie(frame(spark, rows).repartition(3), **options)
    listed = found.collect()
    out = {(r.conv, r.depth, r.parent, r.n_convs, r.n_children, r.n_leaves, r.saved, r.digest) for r in listed}
    assert len(out) == len(listed)
    # Arcs take every place once, and subtrees nest.
    places = sorted([r.enter for r in listed] + [r.exit for r in listed])
    assert places == list(range(2 * len(listed)))
    span = {(r.conv, r.depth): (r.enter, r.exit) for r in listed}
    for r in listed:
        assert r.enter < r.exit
        if r.parent is not None:
            a, b = span[r.parent, r.depth - 1]
            assert a < r.enter and r.exit < b
    return out


@pytest.mark.parametrize("families", [True, False])
def test_against_brute_force(spark, families):
    rows = sample()
    assert got(spark, rows, families=families) == brute(rows, families)


def test_several_levels_of_rulers_and_small_chunks(spark, monkeypatch):
    """Conversations in chunks of 3 turns; the tour ranked by rulers of rulers."""
    monkeypatch.setattr(op, "CHUNK", 3)
    rows = sample(1, 40)
    assert got(spark, rows, every=3, base=6) == brute(rows)


def test_ranking_a_list(spark):
    """A list of which every element is a link further, in random order."""
    names = list(range(500))
    random.Random(2).shuffle(names)
    rows = [(a, b, a % 7) for a, b in zip(names, [*names[1:], None])]
    df = spark.createDataFrame(rows, "at long, next long, w long")
    want, total = {}, 0
    for a, _, w in reversed(rows):
        total += w
        want[a] = total
    for base in (3, 1_000):
        found = op.rank(df, ["w"], op.work_folder(spark), every=4, base=base)
        assert {r.at: r.w for r in found.collect()} == want


def test_broken_list(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, None, 1)], "at long, next long, w long")
    with pytest.raises(Exception, match="one list"):
        op.rank(df, ["w"], op.work_folder(spark)).collect()


def test_empty_and_turnless(spark):
    assert op.trie(frame(spark, [])).count() == 0
    assert op.trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    rows = [(c, 1, "user", "only") for c in range(21, 40)]
    assert got(spark, rows) == brute(rows)


def test_many_conversations_end_at_a_node(spark):
    """Chunks of ids are joined in order."""
    rows = [(c * 37, 1, "user", "hi") for c in range(1, 1_200)]
    found = brute(rows, False)
    assert got(spark, rows, families=False) == found and len(found) == 2


def test_sql(spark):
    rows = sample(3, 60)
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toArrow())
    assert set(con.sql(ORACLES["op13_prefix_trie"]).fetchall()) == brute(rows)
