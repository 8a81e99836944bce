"""Substring dedup with fixed-block anchors.

Every document's text is cut into non-overlapping blocks of ``WINDOW // 2``
words, the anchors.  A window of ``WINDOW`` words that lies in a document holds
at least one of its anchors whole, so two documents that share a window share
an anchor of either: the anchors of all documents are indexed, and every rolling
span of anchor length of every document probes the index.  Hits are extended to
the windows around them, and runs of windows that really occur in an earlier
document are the maximal exact repeats.

The documents are dealt into groups of a few megabytes.  A group sends each
distinct span hash once, with a flag that tells anchors, to the part of the index
that owns the hash, and gets back the hashes that are anchors somewhere and occur
in more than one document.  It then sends each distinct candidate window once,
with its smallest document, and gets back those that occur in a smaller document
of another group.  So a passage that a third of all documents share costs one
entry per group, and nothing is compared pair by pair.  Index parts and groups
grow in number, not in size, with the corpus, and so do the partitions that hold
them.  Rows are dealt by their place in a written table, so rows that repeat an
id and a text spread over the groups like any others.

Anchor hashes only propose.  Windows are told apart by 80 bits of hash (of two
rolling hashes over the words' hashes) beside the bits that choose the part.

Edge cases: a null text has no words; documents of fewer than ``WINDOW`` words
are kept whole.  A document with a null id takes no part and is kept whole.
Rows that share an id are one document: neither is earlier than the other.
Empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle, text_batches, utf8
from .wordbytes import NOT_BLANK, joined, mix, span_hashes, words_in

WINDOW = 50
# Text bytes of a group of documents, and of those whose spans make one part.
GROUP_BYTES = 8_000_000
PART_BYTES = 32_000_000
LEAST_GROUPS = 32
# Partitions beyond which several groups, one after the other, share one.
MOST_PARTITIONS = 20_000

_BASES = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
_KEY = np.uint64((1 << 31) - 1)
_ANCHOR = np.uint32(1 << 31)


def rolling(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up = np.full(len(words), _BASES[which], np.uint64)
    down = np.full(n, pow(_BASES[which], -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down)


class Group:
    """The words of a group of documents, slice after slice."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.anchor = window, window // 2
        self.ids = table["id"].to_numpy()
        inflate = zstandard.ZstdDecompressor().decompress
        self.texts = [inflate(x) for x in table["packed"].to_pylist()]
        column = pa.array(self.texts, pa.large_binary()).view(pa.large_string())
        self.slices = list(words_in(*utf8(column), NOT_BLANK, lower=False))

    def spans(self, words, size: int, *which: int):
        """Place, text and hash of each run of ``size`` words within one text of
        at least ``window`` words that has an id."""
        hashes = span_hashes(words.data, words.start, words.end)
        text_of = words.text_of()
        n = np.diff(words.first)
        last = words.first[1:][text_of] - size
        place = np.flatnonzero((np.arange(len(hashes)) <= last) & (n >= self.window)[text_of])
        return [place, text_of[place], *[rolling(hashes, size, k)[place] for k in which]]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(parts)


def _by_part(part: np.ndarray, parts: int):
    """``(part, from, to)`` of the parts that occur in a sorted array."""
    edges = np.searchsorted(part, np.arange(parts + 1, dtype=part.dtype))
    for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield k, int(edges[k]), int(edges[k + 1])


def _rows(rows: list, names: list[str], types: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names)


_ROUTED = "part bigint, group bigint, load binary"
_ROUTED_TYPES = [pa.int64(), pa.int64(), pa.binary()]


def _probes(group: int, docs: Group, parts: int) -> pa.Table:
    """Each distinct span hash of the group, whether it is an anchor here, and
    whether two of its documents hold it (then it is sent twice)."""
    keys, owners, anchors = [], [], []
    for w in docs.slices:
        place, text, hashes = docs.spans(w, docs.anchor, 0)
        keys.append((_part(hashes, parts) << np.uint64(31)) | (hashes & _KEY))
        owners.append(text + w.lo)
        anchors.append((place - w.first[text]) % docs.anchor == 0)
    key = np.concatenate(keys)
    order = np.argsort(key)
    key, owner = key[order], np.concatenate(owners)[order]
    anchor = np.concatenate(anchors)[order]
    if not len(key):
        return _rows([], ["part", "group", "load"], _ROUTED_TYPES)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    here = np.maximum.reduceat(anchor, first)
    several = np.maximum.reduceat(owner, first) != np.minimum.reduceat(owner, first)
    key = np.repeat(key[first], 1 + several)
    load = (key & _KEY).astype("<u4") | np.where(np.repeat(here, 1 + several), _ANCHOR,
                                                 np.uint32(0))
    part = key >> np.uint64(31)
    return _rows([(k, group, load[a:b].tobytes()) for k, a, b in _by_part(part, parts)],
                 ["part", "group", "load"], _ROUTED_TYPES)


def _answer_probes(table: pa.Table) -> pa.Table:
    """To each group its hashes that are anchors somewhere and occur twice."""
    loads = table["load"].to_pylist()
    entry = np.frombuffer(b"".join(loads), "<u4")
    sender = np.repeat(np.arange(len(loads)), [len(x) // 4 for x in loads])
    key = entry & ~_ANCHOR
    index = np.unique(key[entry >= _ANCHOR])
    at = np.searchsorted(index, key)
    at[at == len(index)] = 0
    found = np.flatnonzero(index[at] == key) if len(index) else np.empty(0, np.int64)
    twice = np.bincount(at[found], minlength=len(index)) > 1
    found = found[twice[at[found]]]
    groups, part = table["group"].to_pylist(), table["part"][0].as_py()
    return _rows([(part, groups[k], np.unique(key[found[a:b]]).tobytes())
                  for k, a, b in _by_part(sender[found], len(loads))],
                 ["part", "group", "load"], _ROUTED_TYPES)


def _keys_of(table: pa.Table) -> np.ndarray:
    """The sorted part-and-hash keys a group got back."""
    keys = [np.empty(0, np.uint64)]
    for part, load in zip(table["part"].to_pylist(), table["load"].to_pylist()):
        keys.append(np.frombuffer(load, "<u4").astype(np.uint64)
                    | np.uint64(part) << np.uint64(31))
    return np.sort(np.concatenate(keys))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return known[at] == keys


_DIGEST = np.dtype([("a", "<u8"), ("b", "<u2")])


def _digests(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), _DIGEST)
    out["a"], out["b"] = a, b & np.uint64(0xFFFF)
    return out


def _windows(group: int, docs: Group, hits: pa.Table, parts: int) -> pa.Table:
    """Each distinct candidate window of the group with its smallest document."""
    known = _keys_of(hits)
    found, owners, routes = [], [], []
    for w in docs.slices:
        if not len(known):
            break
        place, text, hashes = docs.spans(w, docs.anchor, 0)
        hit = _among((_part(hashes, parts) << np.uint64(31)) | (hashes & _KEY), known)
        # Windows that hold a hit whole.
        near = np.zeros(len(w.start) + 1, np.int64)
        back = docs.window - docs.anchor
        np.add.at(near, np.maximum(place[hit] - back, w.first[text[hit]]), 1)
        np.add.at(near, place[hit] + 1, -1)
        place, text, a, b = docs.spans(w, docs.window, 0, 1)
        take = np.cumsum(near)[place] > 0
        found.append(_digests(a[take], b[take]))
        owners.append(docs.ids[text[take] + w.lo])
        routes.append((b[take] >> np.uint64(16)) % np.uint64(parts))
    if not found or not sum(map(len, found)):
        return _rows([], ["part", "group", "load", "ids", "counts"], _WINDOW_TYPES)
    digest, owner = np.concatenate(found), np.concatenate(owners)
    route = np.concatenate(routes)
    order = np.lexsort((owner, digest["b"], digest["a"]))
    digest, owner, route = digest[order], owner[order], route[order]
    one = np.concatenate(([True], digest[1:] != digest[:-1]))
    digest, owner, route = digest[one], owner[one], route[one]
    order = np.lexsort((owner, route))
    digest, owner, route = digest[order], owner[order], route[order]
    rows = []
    for k, lo, hi in _by_part(route, parts):
        ids, counts = np.unique(owner[lo:hi], return_counts=True)
        rows.append((k, group, digest[lo:hi].tobytes(), ids.astype("<i8").tobytes(),
                     counts.astype("<u4").tobytes()))
    return _rows(rows, ["part", "group", "load", "ids", "counts"], _WINDOW_TYPES)


_WINDOWS = "part bigint, group bigint, load binary, ids binary, counts binary"
_WINDOW_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _answer_windows(table: pa.Table) -> pa.Table:
    """To each group its windows that occur in a smaller document elsewhere."""
    loads = table["load"].to_pylist()
    digest = np.frombuffer(b"".join(loads), _DIGEST)
    sender = np.repeat(np.arange(len(loads)), [len(x) // _DIGEST.itemsize for x in loads])
    owner = np.concatenate([
        np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(n, "<u4"))
        for i, n in zip(table["ids"].to_pylist(), table["counts"].to_pylist())])
    order = np.lexsort((owner, digest["b"], digest["a"]))
    d, o = digest[order], owner[order]
    first = np.concatenate(([True], d[1:] != d[:-1]))
    least = o[np.flatnonzero(first)[np.cumsum(first) - 1]]
    late = np.zeros(len(d), bool)
    late[order] = o > least
    groups, part = table["group"].to_pylist(), table["part"][0].as_py()
    chosen = np.flatnonzero(late)
    return _rows([(part, groups[k], digest[chosen[a:b]].tobytes())
                  for k, a, b in _by_part(sender[chosen], len(loads))],
                 ["part", "group", "load"], _ROUTED_TYPES)


KEPT = ("id bigint, n_words bigint, n_removed bigint,"
        " spans array<struct<start:bigint, stop:bigint>>, kept string")
_KEPT_TYPES = [pa.int64(), pa.int64(), pa.int64(),
               pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]


def _kept(docs: Group, late: pa.Table) -> pa.Table:
    """The documents without the words of windows that are not the first."""
    loads = late["load"].to_pylist()
    known = np.sort(np.frombuffer(b"".join(loads), _DIGEST), order=["a", "b"])
    # Earlier documents of the same group decide by themselves.
    parts = []
    for w in docs.slices:
        place, text, a, b = docs.spans(w, docs.window, 0, 1)
        parts.append((place, text, _digests(a, b)))
    digest = np.concatenate([np.empty(0, _DIGEST), *[p[2] for p in parts]])
    owner = np.concatenate([np.empty(0, np.int64),
                            *[docs.ids[p[1] + w.lo] for p, w in zip(parts, docs.slices)]])
    order = np.lexsort((owner, digest["b"], digest["a"]))
    d, o = digest[order], owner[order]
    gone = np.zeros(len(d), bool)
    if len(d):
        first = np.concatenate(([True], d[1:] != d[:-1]))
        gone[order] = o > o[np.flatnonzero(first)[np.cumsum(first) - 1]]
    if len(known):
        # Equal first halves are rare, so a short walk settles the second half.
        at = np.searchsorted(known["a"], digest["a"])
        while True:
            open_ = at < len(known)
            same = np.zeros(len(digest), bool)
            same[open_] = known["a"][at[open_]] == digest["a"][open_]
            gone[same] |= known["b"][at[same]] == digest["b"][same]
            if not same.any():
                break
            at[~same] = len(known)
            at[same] += 1
    rows, done = [], 0
    for w, (place, _, _) in zip(docs.slices, parts):
        away = place[gone[done:done + len(place)]]
        done += len(place)
        edge = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(edge, away, 1)
        np.add.at(edge, away + docs.window, -1)
        removed = np.cumsum(edge[:-1]) > 0
        text, start, end = joined(w)
        for k in range(w.hi - w.lo):
            lo, hi = int(w.first[k]), int(w.first[k + 1])
            own = removed[lo:hi]
            if not own.any():
                kept = text[start[lo]:end[hi - 1]] if hi > lo else b""
                rows.append((docs.ids[w.lo + k], hi - lo, 0, [], kept))
                continue
            turn = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
            spans = list(zip(turn[::2], turn[1::2]))
            stay = zip([0, *turn[1::2]], [*turn[::2], hi - lo])
            kept = b" ".join([text[start[lo + a]:end[lo + b - 1]] for a, b in stay if b > a])
            rows.append((docs.ids[w.lo + k], hi - lo, int(own.sum()),
                         [{"start": a, "stop": b} for a, b in spans], kept))
    rows = [(*r[:4], r[4].decode()) for r in rows]
    return _rows(rows, ["id", "n_words", "n_removed", "spans", "kept"], _KEPT_TYPES)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that take no part."""
    for batch in batches:
        rows = []
        for w in words_in(*utf8(batch.column("text")), NOT_BLANK, lower=False):
            text, start, end = joined(w)
            for k in range(w.hi - w.lo):
                lo, hi = int(w.first[k]), int(w.first[k + 1])
                kept = text[start[lo]:end[hi - 1]].decode() if hi > lo else ""
                rows.append((None, hi - lo, 0, [], kept))
        yield from _rows(rows, ["id", "n_words", "n_removed", "spans", "kept"],
                         _KEPT_TYPES).to_batches()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, group_bytes: int = GROUP_BYTES,
                   part_bytes: int = PART_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, spans, kept)`` for each document.

    ``spans`` are the removed word ranges, ``kept`` the other words joined by one
    space.  Words go where a window that covers them also starts in a document
    with a smaller id.  Ids are whole numbers.  Runs jobs that add up the sizes of
    the texts and write them, compressed.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    text_batches()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-size // group_bytes))
    parts = max(LEAST_GROUPS, -(-size // part_bytes))

    def pack(batches):
        deflate = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [deflate((x or "").encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(texts, pa.binary())],
                ["row", "id", "packed"])

    # Written, so that a row keeps its place, and with it its group, in every pass.
    packed = settle(rows.where("id IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
                    .mapInArrow(pack, "row bigint, id bigint, packed binary"))

    def by_group(df):
        return df.repartition(min(groups, MOST_PARTITIONS), "group").groupBy("group")

    def by_part(df):
        return df.repartition(min(parts, MOST_PARTITIONS), "part").groupBy("part")

    dealt = by_group(packed.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"),
                                   "id", "packed"))

    def key(table):
        return table["group"][0].as_py()

    probes = dealt.applyInArrow(lambda t: _probes(key(t), Group(t, window), parts), _ROUTED)
    hits = by_part(probes).applyInArrow(_answer_probes, _ROUTED)
    windows = dealt.cogroup(by_group(hits)).applyInArrow(
        lambda t, h: _windows(key(t), Group(t, window), h, parts), _WINDOWS)
    late = by_part(windows).applyInArrow(_answer_windows, _ROUTED)
    kept = dealt.cogroup(by_group(late)).applyInArrow(
        lambda t, h: _kept(Group(t, window), h), KEPT)
    nameless = rows.where("id IS NULL").mapInArrow(_whole, KEPT)
    return kept.unionByName(nameless)
