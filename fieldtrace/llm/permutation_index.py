"""Approximate nearest neighbours with a permutation index.

Every vector is represented by the order of its nearest pivots, half of all pivots.
In each shard of the index a pivot has an inverted file: the vectors that list it,
with the place they list it at.  A query reads the files of its own nearest pivots
and adds up the footrule distance, sum over these pivots of ``|place in the query -
place in the vector|`` (a pivot a vector does not list counts as listed last).  The
nearest ``depth`` share of a shard by footrule, at least ``SPARE`` times ``k``, is
reranked by the exact inner product in double precision.

The largest inner product is not the smallest distance where lengths differ.  So
vectors and pivots get one more component that makes all of them as long as the
longest, and queries a zero there: then the two agree.

Equal vectors are indexed once, with the smallest ``k + 1`` ids of each; ties go
to smaller ids, so no other id of them can be among the ``k`` nearest.  Queries
and shards meet in blocks of bounded size.

The pivots are the distinct vectors with the smallest hash of their smallest id:
a sample of ``pivots`` rows, whatever the size of the table.  All rows are indexed.

Edge cases: vectors that are null or zero, hold a null or non-finite component
or have another number of components than most rows have (the larger number, if two
are as frequent) take no part, nor do rows whose id is null.  Rows that repeat an id with equal vectors count once; with other
vectors each counts.  An empty table gives an empty result; with fewer than
``k`` candidates all are returned.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settle, work_folder

PIVOTS = 256
# Pivots in a vector's order, and those of a query whose files are read.
LISTED = 128
READ = 64
K = 20
# Share of a shard's vectors that is reranked, and how many for each one asked for.
DEPTH = 0.15
SPARE = 8
SHARD_ROWS = 8_192
QUERY_ROWS = 8_192
# Ids that one task lists for equal vectors.
SALT_ROWS = 1_000_000

_INDEX = ("shard bigint, ids binary, id_counts binary, vectors binary, members binary,"
          " places binary, files binary")
_INDEX_TYPES = [pa.int64()] + [pa.binary()] * 6
_FOUND = "query bigint, score double, id bigint"


def usable(v: Column) -> Column:
    """No null, infinite or missing component, and not zero."""
    ok = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array(column).combine_chunks() if isinstance(column, list) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with one more component that makes them ``longest`` long."""
    more = longest ** 2 - np.square(vectors).sum(axis=1)
    return np.hstack((vectors, np.sqrt(np.maximum(more, 0))[:, None]))


def _orders(vectors: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """Of each vector its nearest pivots, nearest first.  Both are lifted."""
    near = np.empty((len(vectors), listed), np.int64)
    for at in range(0, len(vectors), 2048):
        products = vectors[at:at + 2048] @ pivots.T
        near[at:at + 2048] = np.argsort(-products, axis=1, kind="stable")[:, :listed]
    return near


def _smallest(n: int) -> str:
    """The narrowest type for numbers below ``n``."""
    return "<u1" if n <= 1 << 8 else "<u2" if n <= 1 << 16 else "<u4"


def _shard(table: pa.Table, pivots: np.ndarray, longest: float, listed: int) -> pa.Table:
    """The index of one shard as a row: vectors, ids and the inverted files."""
    table = table.sort_by("least")
    vectors = _matrix(table["vector"])
    near = _orders(lifted(vectors, longest), pivots, listed)
    member = np.repeat(np.arange(len(vectors)), listed)
    place = np.tile(np.arange(listed), len(vectors))
    pivot = near.reshape(-1)
    order = np.argsort(pivot, kind="stable")
    files = np.searchsorted(pivot[order], np.arange(len(pivots) + 1))
    ids = table["ids"].combine_chunks()
    row = [[table["shard"][0].as_py()], [ids.flatten().to_numpy().astype("<i8").tobytes()],
           [ids.value_lengths().to_numpy().astype("<i4").tobytes()],
           [vectors.astype("<f8").tobytes()],
           [member[order].astype(_smallest(len(vectors))).tobytes()],
           [place[order].astype(_smallest(listed)).tobytes()], [files.astype("<i8").tobytes()]]
    return pa.table([pa.array(c, t) for c, t in zip(row, _INDEX_TYPES)],
                    [c.split()[0] for c in _INDEX.split(", ")])


def _search(queries: pa.Table, index: pa.Table, pivots: np.ndarray, listed: int, read: int,
            k: int, depth: float) -> pa.Table:
    """The nearest ``k`` ids of one shard for each query of a block."""
    out = ([np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)])
    if len(queries) and len(index):
        one = {c: index[c][0].as_py() for c in index.column_names}
        ids, counts = np.frombuffer(one["ids"], "<i8"), np.frombuffer(one["id_counts"], "<i4")
        vectors = np.frombuffer(one["vectors"], "<f8").reshape(len(counts), -1)
        members = np.frombuffer(one["members"], _smallest(len(counts)))
        places = np.frombuffer(one["places"], _smallest(listed)).astype(np.int32)
        files = np.frombuffer(one["files"], "<i8")
        first = np.cumsum(counts) - counts
        asked = _matrix(queries["vector"])
        near = _orders(np.hstack((asked, np.zeros((len(asked), 1)))), pivots, read)
        take = min(len(counts), max(SPARE * k, int(np.ceil(depth * len(counts)))))
        # The place at which each vector lists each pivot that a query reads.
        used, row = np.unique(near, return_inverse=True)
        row = row.reshape(near.shape)
        listing = np.full((len(used), len(counts)), listed, np.int16)
        for nth, pivot in enumerate(used.tolist()):
            lo, hi = files[pivot], files[pivot + 1]
            listing[nth, members[lo:hi]] = places[lo:hi]
        at = np.arange(read, dtype=np.int16)[:, None]
        for q, name in enumerate(queries["query"].to_pylist()):
            footrule = np.abs(listing[row[q]] - at).sum(axis=0, dtype=np.int32)
            if take < len(counts):
                bound = np.partition(footrule, take - 1)[take - 1]
                some = np.flatnonzero(footrule <= bound)
            else:
                some = np.arange(len(counts))
            # Row by row, so that equal vectors get equal scores.
            scores = (vectors[some] * asked[q]).sum(axis=1)
            if len(some) > k:
                edge = np.partition(scores, len(some) - k)[len(some) - k]
                some, scores = some[scores >= edge], scores[scores >= edge]
            n = counts[some]
            last = np.cumsum(n)
            own = ids[np.repeat(first[some] - (last - n), n) + np.arange(last[-1])]
            score = np.repeat(scores, n)
            best = np.lexsort((own, -score))[:k]
            out[0].append(np.full(len(best), name))
            out[1].append(score[best])
            out[2].append(own[best])
    return pa.table([np.concatenate(c) for c in out], ["query", "score", "id"])


def distinct_vectors(rows: DataFrame, keep: int, salts: int) -> DataFrame:
    """``(vector, ids)`` with the smallest ``keep`` ids of each, sorted."""
    def smallest(ids):
        return F.slice(F.array_sort(F.array_distinct(ids)), 1, keep)

    salted = (rows.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
              .agg(smallest(F.collect_list("id")).alias("ids")))
    return salted.groupBy("vector").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id",
           vector_col: str = "embedding", k: int = K, pivots: int = PIVOTS,
           listed: int = LISTED, read: int = READ, depth: float = DEPTH,
           shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest rows found for each row
    with ``is_query``, without the row itself.  Ids are whole numbers.  Runs jobs.
    """
    folder = work_folder(vectors.sparkSession)
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    width = widths.agg(F.max(F.struct("n", "width"))["width"]).first()[0] or 0
    rows = rows.where(F.size("vector") == width)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    longest = float(np.sqrt(rows.agg(F.max(square)).first()[0] or 0.0))

    n = rows.count()
    classes = settle(distinct_vectors(rows, k + 1, 1 + n // SALT_ROWS)
                     .withColumn("least", F.col("ids")[0]), folder)
    sample = classes.orderBy(F.xxhash64("least"), "least", "vector").select("vector").limit(pivots)
    sample = np.array([r["vector"] for r in sample.collect()], np.float64).reshape(-1, max(width, 1))
    sample = lifted(sample, longest)
    listed = min(listed, len(sample))
    read = min(read, listed)
    shards = max(1, -(-classes.count() // shard_rows))
    index = (classes.withColumn("shard", F.pmod(F.xxhash64("least"), F.lit(shards)))
             .groupBy("shard").applyInArrow(lambda t: _shard(t, sample, longest, listed), _INDEX))
    index = settle(index, folder)

    asked = settle(rows.where("asks").select("id", "vector").join(
        classes.select("vector", "least"), "vector").select("id", "least"), folder)
    wanted = settle(asked.select("least").distinct().join(
        classes.select("least", "vector"), "least").select(
            F.col("least").alias("query"), "vector"), folder)
    blocks = max(1, -(-wanted.count() // query_rows))
    # Each block of queries meets each shard once.
    left = wanted.select(
        "query", "vector", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"))
    right = index.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        lambda q, i: _search(q, i, sample, listed, read, k + 1, depth), _FOUND)
    # At most k + 1 rows of each shard come together for a query.
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("s"), "id"))), 1, k + 1).alias("best"))
    mine = asked.join(best, asked["least"] == best["query"])
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("asked")), 1, k)
    return (mine.select(F.col("id").alias("asked"), "best").distinct()
            .select("asked", F.posexplode(others).alias("at", "hit"))
            .select(F.col("asked").alias("query_id"), (F.col("at") + 1).alias("rank"),
                    F.col("hit.id").alias("id"), (-F.col("hit.s")).alias("score")))
