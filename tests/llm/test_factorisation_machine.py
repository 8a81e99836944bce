"""Held-out accuracy, the linear-time identity, and edge cases."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldtrace.llm import factorisation_machine as op

from .conftest import EDGES, text_frame

DIR = "/root/testdata/sf0.01"


def test_pairwise_sum_identity():
    rng = np.random.default_rng(2)
    x = rng.random((5, op.WIDTH))
    model = op.Model(0.3, np.zeros(op.STRUCTURE), np.ones(op.STRUCTURE),
                     rng.normal(0, 0.1, op.WIDTH), rng.normal(0, 0.1, (op.WIDTH, op.FACTORS)))
    z = op.standard(x, model.mean, model.scale)
    gram = model.factors @ model.factors.T
    for row, got in zip(z, model.score(x)):
        pairs = sum(float(gram[i, i + 1:] @ row[i + 1:]) * row[i] for i in range(len(row)))
        assert abs(got - 1 / (1 + np.exp(-(0.3 + row @ model.linear + pairs)))) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = op.train(docs, labels.where(fold != 0))
    rows = (docs.select("doc_id", op.score(F.col("text"), model).alias("score"))
            .join(labels, "doc_id").where(fold == 0).collect())
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = np.mean([(r.score >= op.THRESHOLD) == (r.quality == 1) for r in rows])
    clean = [r.score >= op.THRESHOLD for r in rows if r.quality == 1]
    assert good >= 0.97 and np.mean(clean) >= 0.99


def test_edges(spark):
    docs = text_frame(spark, EDGES)
    labels = spark.createDataFrame([(90_004, 1), (90_006, 0), (None, 1), (90_002, None), (90_006, 1)],
                                   "doc_id long, quality int")
    model = op.train(docs, labels)
    scored = docs.select("doc_id", "text", op.score(F.col("text"), model).alias("score")).collect()
    assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
    by_text = {r.text: r.score for r in scored}
    assert by_text[None] == by_text[""]
    kept = op.keep_good(docs, model)
    assert kept.columns == docs.columns
    blank = op.train(docs, labels.limit(0))
    assert set(docs.select(op.score(F.col("text"), blank).alias("s")).toPandas().s) == {0.5}
    assert op.keep_good(docs.limit(0), blank).count() == 0


def test_scores_do_not_depend_on_neighbours():
    texts = ["A b c.\nA b c.", "", "x" * 50, "Ünï ü\tü"]
    alone = np.concatenate([next(op.vectors(pa.array([t]))) for t in texts])
    assert np.allclose(alone, next(op.vectors(pa.array(texts))))


def test_metadata_is_an_input(spark):
    """Texts that are alike are told apart by a column; missing values have a score."""
    rows = [(k, "same words here", float(1000 * (k % 2))) for k in range(60)]
    odd = [(100, "same words here", None), (101, None, float("nan")), (102, "", float("-inf")), (103, "x", -5.0),
           (104, "same words here", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, size double").withColumn("meta_0", F.lit("own"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = op.train(docs, labels, meta=("size",))
    assert len(model.linear) == op.WIDTH + 2
    got = {r.doc_id: r.score for r in docs.select("doc_id", op.score(F.col("text"), model).alias("score")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[100] == got[104]
    assert min(got[k] for k in range(1, 60, 2)) > 0.8 and max(got[k] for k in range(0, 60, 2)) < 0.2
    assert {r.doc_id for r in op.keep_good(docs, model).collect()} >= set(range(1, 60, 2))
    blank = op.train(docs, labels.limit(0), meta=("size",))
    assert set(docs.select(op.score(F.col("text"), blank).alias("s")).toPandas().s) == {0.5}
