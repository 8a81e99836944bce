"""Fingerprints, linking and keeping against brute force."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldtrace.llm import covering_simhash as op

from .conftest import ASCII_LOWER, EDGES, blank_words, text_frame


def fingerprint(text):
    words = blank_words((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42)
              for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= radius:
            parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_difference(radius):
    masks = op.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for places in itertools.islice(itertools.combinations(range(64), radius), 0, None, 53):
        differing = sum(1 << p for p in places)
        assert any(m & differing == 0 for m in masks)


def test_components(spark, sample_texts):
    rows = sample_texts + EDGES + [(90_007, sample_texts[3][1]), (90_008, sample_texts[3][1] + " x")]
    prints = {t: fingerprint(t) for _, t in rows}
    label = classes(set(prints.values()), 4)
    smallest = {}
    for doc, text in rows:
        if doc is not None:
            k = label[prints[text]]
            smallest[k] = min(smallest.get(k, doc), doc)
    want = sorted(((d, prints[t], smallest.get(label[prints[t]])) for d, t in rows), key=repr)
    docs = text_frame(spark, rows)
    got = sorted(((r.id, r.fp & (2 ** 64 - 1), r.component_id)
                  for r in op.near_duplicates(docs).collect()), key=repr)
    assert got == want
    kept = op.keep_first(docs)
    assert kept.columns == docs.columns
    # Of every component its smallest id stays, once for repeated rows.
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == sorted(
        {c for _, _, c in want}, key=repr)


def test_one_row_of_each_component_stays(spark):
    """One id with two near texts, and components without ids."""
    words = [f"w{k}" for k in range(400)]
    near = [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in (5, 100, 200, 300)]
    far = [" ".join(f"v{k}{c}" for k in range(300)) for c in "ab"]
    rows = [(7, near[0]), (7, near[1]), (7, near[1]), (9, near[2]), (None, near[3])]
    rows += [(None, far[0])] * 3 + [(None, far[1]), (12, far[1]), (12, "alone here and now at last")]
    prints = {t: fingerprint(t) for _, t in rows}
    label = classes(sorted(prints.values()), 4)
    groups = {label.get(p, p) for p in prints.values()}
    assert len(groups) == 4 and len(set(prints.values())) >= 6
    kept = [(r.doc_id, r.text) for r in op.keep_first(text_frame(spark, rows)).collect()]
    assert len(kept) == 4
    assert sorted((d for d, _ in kept), key=repr) == [12, 12, 7, None]
    assert {label.get(prints[t], prints[t]) for _, t in kept} == groups


def test_dense_groups_lose_no_link(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(120):
            p = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                p ^= 1 << b
            prints.add(p - (1 << 64) if p >> 63 else p)
    label = classes(sorted(prints), 4)
    members = {}
    for p, k in label.items():
        members.setdefault(k, set()).add(p)
    frame = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    got = {r.node: r.label for r in op.linked(frame).collect()}
    for group in members.values():
        assert {got.get(p, p) for p in group} == {min(group)}


def test_empty(spark):
    docs = text_frame(spark, [])
    assert op.near_duplicates(docs).count() == 0 and op.keep_first(docs).count() == 0


def test_long_text_counts_all_hashes(spark):
    text = " ".join(f"w{k}" for k in range(70_000))
    docs = spark.createDataFrame([(text,)], "text string")
    got = docs.select(op.fingerprint(F.col("text")).alias("p")).first().p
    assert got & (2 ** 64 - 1) == fingerprint(text)


def written_plans(monkeypatch):
    """The plans of what the operator writes, as they are once they ran."""
    plans, write = [], op.settle

    def settle(df, folder=None):
        out = write(df, folder)
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(op, "settle", settle)
    return plans


def unsent(plans):
    """The rows exploded over the masks are joined, and not by a broadcast."""
    exploded = [p for p in plans if "Generate explode" in p]
    return bool(exploded) and all("Join" in p and "Broadcast" not in p for p in exploded)


def test_keep_first_sends_no_exploded_rows(spark, sample_texts, monkeypatch):
    plans = written_plans(monkeypatch)
    op.keep_first(text_frame(spark, sample_texts)).collect()
    assert unsent(plans)


def test_near_duplicates_sends_no_exploded_rows(spark, sample_texts, monkeypatch):
    plans = written_plans(monkeypatch)
    op.near_duplicates(text_frame(spark, sample_texts)).collect()
    assert unsent(plans)
