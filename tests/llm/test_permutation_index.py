"""Recall, exact scores and order against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import permutation_index as op

from .conftest import with_clashes

NAN, INF = float("nan"), float("inf")


def brute(rows, asks, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8
            and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    out = {}
    for i, v in good.items():
        if asks(i):
            near = sorted((-(w * v).sum(), j) for j, w in good.items() if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((r.id, r.score))
        assert r["rank"] == len(own)
    return out


def frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def vectors(n, seed=0, width=8):
    x = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    return [(k, [float(c) for c in v]) for k, v in enumerate(x)]


def test_reranking_all_is_exact(spark):
    rows = vectors(400)
    rows += [(1000 + k, rows[7][1]) for k in range(60)]                       # a large group of equals
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [NAN] + [1.0] * 7), (2060, [INF] + [1.0] * 7),
             (2080, [None] + [1.0] * 7), (2100, [1.0, 2.0]), (None, [1.0] * 8), (20, rows[20][1])]
    got = found(op.search(frame(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=100, query_rows=30,
                          depth=1.0, pivots=16, listed=10, read=4))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=0, atol=1e-12)


def recall(found_, ids, x):
    out = []
    for at in np.flatnonzero(ids % 20 == 0):
        score = (x * x[at]).sum(1)
        score[at] = -INF
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        out.append(len(best & {i for i, _ in found_[int(ids[at])]}) / 20)
    return np.mean(out)


def test_recall(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in data.select("vec_id", "embedding").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    assert recall(found(op.search(data, F.col("vec_id") % 20 == 0)), ids, x) >= 0.93


def test_recall_where_lengths_differ(spark):
    """Few long vectors are near to most queries; their order of pivots must show it."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6_000, 64))
    x *= rng.lognormal(0, 0.5, (6_000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = frame(spark, [(k, [float(c) for c in v]) for k, v in enumerate(x)])
    got = found(op.search(df, F.col("vec_id") % 20 == 0, shard_rows=2_000))
    assert recall(got, np.arange(6_000), x.astype(float)) >= 0.95


def test_malformed_rows_do_not_decide(spark):
    rows = vectors(200) + [(9_000 + k, [1.0, 2.0]) for k in range(30)] + [(9_100, [])]
    got = found(op.search(frame(spark, rows), F.col("vec_id") % 20 == 0))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and len(got) == 10


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    got = found(op.search(frame(spark, vectors(n)), F.lit(True)))
    want = brute(vectors(n), lambda i: True, 20)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {
        q: [i for i, _ in near] for q, near in want.items() if near}
