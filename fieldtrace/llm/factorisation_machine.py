"""Quality classifier: a factorisation machine over hashed words and structure.

Each text becomes one vector: square roots of the shares of its words in hashed
buckets, statistics of its structure (shares of byte classes, marks, repeated
words and lines), its size, and metadata: of each column named by the caller its
logarithm, and whether it is missing.  The score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),

with the pairwise part taken in linear time as
``(|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2``.

The model is fitted on at most ``max_rows`` labelled rows (those with the
smallest hash of their id), by gradient steps on the driver.  Every text is
scored whole, in batches on the executors.  Only the text and the named metadata
are inputs.

Edge cases: null texts count as empty; an empty text has a score like any other
(its vector holds structure only).  Metadata that is null, NaN or infinite is
missing.  Rows with a null label or id are not learnt
from; ids that are labelled twice count with their smallest label.  Without
labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .frames import text_batches, utf8
from .wordbytes import LOWER, NOT_BLANK, span_hashes, words_in

BUCKETS = 2048
FACTORS = 8
MAX_ROWS = 8_000
THRESHOLD = 0.3

_ALL = np.arange(256)
_MARKS = b"#$%&*!|{}<>=/\\_+~^@[]();:\"'.,?-"
_CLASSES = [
    (_ALL >= 0x41) & (_ALL <= 0x5A), (_ALL >= 0x61) & (_ALL <= 0x7A),
    (_ALL >= 0x30) & (_ALL <= 0x39), _ALL >= 0x80, _ALL == 0x0A,
    *[_ALL == m for m in _MARKS],
]
# Structure: byte classes, word statistics, line statistics, size.
STRUCTURE = len(_CLASSES) + 10
WIDTH = BUCKETS + STRUCTURE


@dataclass
class Model:
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    meta: tuple[str, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        x = standard(x, self.mean, self.scale)
        cross = ((x @ self.factors) ** 2).sum(1) - ((x * x) @ (self.factors ** 2)).sum(1)
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.linear + cross / 2, -30, 30)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Structure centred and scaled, far values drawn in; words as they are."""
    x = x.astype(np.float64)
    x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - mean) / scale, -4, 4) / 4
    return x


def _unique_shares(owner: np.ndarray, keys: np.ndarray, n: int, total: np.ndarray):
    """Of each text the share of distinct keys, and of its most frequent key."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])))[:len(o)])
    runs = np.diff(np.append(new, len(o)))
    distinct = np.bincount(o[new], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, o[new], runs)
    total = np.maximum(total, 1)
    return distinct / total, most / total


def meta_vectors(columns: list[pa.Array], n: int) -> np.ndarray:
    """Signed logarithm of each metadata column, and whether it is missing."""
    out = np.zeros((n, 2 * len(columns)), np.float32)
    for k, column in enumerate(columns):
        value = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = np.isfinite(value)
        value = np.where(known, value, 0)
        out[:, 2 * k] = np.sign(value) * np.log1p(np.abs(value))
        out[:, 2 * k + 1] = ~known
    return out


def vectors(column: pa.Array, meta: list[pa.Array] = ()) -> Iterator[np.ndarray]:
    """The vectors of a batch of texts, slice by slice."""
    view, offsets = utf8(column)
    more = meta_vectors(meta, len(column))
    for w in words_in(view, offsets, NOT_BLANK, lower=False):
        n = w.hi - w.lo
        x = np.zeros((n, WIDTH), np.float32)
        text_of, words = w.text_of(), np.diff(w.first)
        hashes = span_hashes(LOWER[w.data], w.start, w.end)
        bucket = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        counts = np.bincount(text_of * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        x[:, :BUCKETS] = np.sqrt(counts / np.maximum(words, 1)[:, None])

        begins = offsets[w.lo:w.hi + 1] - offsets[w.lo] + np.arange(n + 1)
        size = np.diff(begins) - 1
        owner = np.repeat(np.arange(n), size + 1)
        byte = np.bincount(owner * 256 + w.data, minlength=n * 256).reshape(n, 256)
        byte[:, 0x0A] -= 1     # the newline after each text is not part of it
        shares = byte / np.maximum(size, 1)[:, None]
        at = BUCKETS
        for kind in _CLASSES:
            x[:, at] = np.sqrt(np.maximum(shares[:, kind].sum(1), 0))
            at += 1
        length = w.end - w.start
        x[:, at] = np.bincount(text_of, length, n) / np.maximum(words, 1)
        x[:, at + 1], x[:, at + 2] = _unique_shares(text_of, hashes, n, words)
        # Words without any letter, digit or non-ASCII byte, and words in capitals.
        plain = np.concatenate(([0], np.cumsum(_PLAIN[w.data])))
        x[:, at + 3] = np.bincount(text_of, plain[w.end] == plain[w.start], n) / np.maximum(words, 1)
        small = np.concatenate(([0], np.cumsum(_CLASSES[1][w.data])))
        x[:, at + 4] = np.bincount(text_of, small[w.end] == small[w.start], n) / np.maximum(words, 1)
        stop = np.flatnonzero(w.data == 0x0A)
        line_of = owner[stop]
        start = np.concatenate(([0], stop[:-1] + 1))
        lines = np.bincount(line_of, minlength=n)
        x[:, at + 5], x[:, at + 6] = _unique_shares(
            line_of, span_hashes(w.data, start, stop), n, lines)
        x[:, at + 7] = np.log1p(lines)
        x[:, at + 8] = np.log1p(size)
        twice = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        x[:, at + 9] = np.bincount(text_of[1:], twice, n) / np.maximum(words, 1)
        yield np.hstack((x, more[w.lo:w.hi])) if len(meta) else x


_PLAIN = _CLASSES[0] | _CLASSES[1] | _CLASSES[2] | _CLASSES[3]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 256, rate: float = 0.01,
        decay: float = 1e-3, seed: int = 7, meta: tuple[str, ...] = ()) -> Model:
    """Adam steps on the logistic loss, by batches in a fixed order."""
    width = x.shape[1]
    if not len(y):
        return Model(0.0, np.zeros(width - BUCKETS), np.ones(width - BUCKETS), np.zeros(width),
                     np.zeros((width, FACTORS)), meta)
    mean = x[:, BUCKETS:].mean(0, dtype=np.float64)
    scale = x[:, BUCKETS:].std(0, dtype=np.float64) + 1e-3
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99)
    p = [np.array([np.log(share / (1 - share))]), np.zeros(width),
         rng.normal(0, 0.02, (width, FACTORS))]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        some = rng.integers(0, len(y), min(batch, len(y)))
        z, t = standard(x[some], mean, scale), y[some]
        q = z @ p[2]
        sq = z * z
        out = p[0][0] + z @ p[1] + ((q ** 2).sum(1) - (sq @ p[2] ** 2).sum(1)) / 2
        g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - t) / len(t)
        grads = [np.array([g.sum()]), z.T @ g + decay * p[1],
                 z.T @ (g[:, None] * q) - p[2] * (sq.T @ g)[:, None] + decay * p[2]]
        slow = rate * (1 - 0.9 * step / steps)
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad * grad
            p[k] = p[k] - slow * (m[k] / (1 - 0.9 ** step)) / (
                np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(p[0][0]), mean, scale, p[1], p[2], meta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = MAX_ROWS,
          meta: tuple[str, ...] = ()) -> Model:
    """Fit on at most ``max_rows`` rows of ``labels``; runs jobs.

    ``meta`` names columns of numbers of ``docs`` that are features, too.

    The sample is small by its bound, so it is broadcast to the documents, and
    only its vectors come back.
    """
    text_batches()
    sample = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).cast("double").alias("label"))
              .orderBy(F.xxhash64("key"), "key").limit(max_rows))
    names = [f"meta_{k}" for k in range(len(meta))]
    rows = (docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"),
                        *[F.col(c).cast("double").alias(n) for c, n in zip(meta, names)])
            .join(F.broadcast(sample), "key"))

    def as_bytes(batches):
        for batch in batches:
            x = [v.tobytes() for part in vectors(batch.column("text"), [batch.column(n) for n in names])
                 for v in part.astype(np.float16)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").cast(pa.string()), batch.column("label"),
                 pa.array(x, pa.binary())], ["key", "label", "x"])

    got = rows.mapInArrow(as_bytes, "key string, label double, x binary").toArrow()
    got = got.sort_by([("key", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(
        -1, WIDTH + 2 * len(meta))
    return fit(x.astype(np.float32), got["label"].to_numpy(), meta=tuple(meta))


def score(text: Column, model: Model) -> Column:
    """The probability of label 1 for a text; the model's metadata columns stand beside it."""
    text_batches()

    if not model.meta:
        @arrow_udf("double")
        def machine(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                yield pa.array(np.concatenate([np.empty(0), *map(model.score, vectors(column))]))

        return machine(text)

    @arrow_udf("double")
    def machine_with_meta(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column, *meta in batches:
            yield pa.array(np.concatenate([np.empty(0), *map(model.score, vectors(column, meta))]))

    return machine_with_meta(text, *[F.col(c).cast("double") for c in model.meta])


def keep_good(docs: DataFrame, model: Model, text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least ``threshold``."""
    return docs.where(score(F.col(text_col), model) >= threshold)
