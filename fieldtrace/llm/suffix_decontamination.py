"""Benchmark decontamination with training suffix arrays.

The documents are read in shards (slices of a few megabytes, whole texts only).
A shard's words become numbers, and a suffix array over them is built by prefix
doubling.  Suffixes that no test item can match for as many words as the
shortest window are left out first: those that begin with fewer consecutive
words of the items' vocabulary.  Every suffix of every test item is then found
by binary search, word by word: the interval at window length gives all
occurrences of that window.  The suffixes of documents and items that share a
window are then sorted together, and the nearest item suffixes of a document
suffix give its longest verbatim match and where it lies (:func:`matches`).
:func:`longest_matches` tells the same from the items' side.

A window is ``window`` consecutive words of an item, or the whole item if it has
fewer.  Words are compared by 64-bit hashes.

The items are sent to the tasks in blocks of at most ``block_bytes`` of text,
whose number follows from a count; with more than one block the documents are
passed over once per block, and a block is dropped before the next one is sent.
Items that repeat an id and a text are sent once.

Edge cases: null texts have no words; items without words match nothing.  Items
that share an id count once, an item whose id is null counts under the empty
string.  Ids of documents are only carried along.  Empty tables give empty
results.  Other columns are not read, or kept as they are by :func:`remove`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .frames import settle, text_batches, utf8, work_folder
from .wordbytes import ALNUM, span_hashes, words_in

WINDOW = 10
BLOCK_BYTES = 16_000_000

HITS = ("struct<n_words:bigint, n_hit:bigint, spans:array<struct<start:bigint, stop:bigint>>,"
        " items:array<string>, longest:struct<length:bigint, start:bigint, item:string, item_start:bigint>>")


@dataclass
class Items:
    """A block of test items as one run of word numbers, 0 after each item."""
    ids: list[str]
    vocabulary: np.ndarray   # sorted word hashes; a word's number is its place + 1
    words: np.ndarray
    item: np.ndarray         # of each place, the item's number
    left: np.ndarray         # words to the item's end
    window: int
    place: np.ndarray        # of each word, its place in its item


def _items(rows, window: int) -> Items:
    ids = sorted({"" if r[0] is None else str(r[0]) for r in rows})
    number = {name: k for k, name in enumerate(ids)}
    view, offsets = utf8(pa.array([r[1] for r in rows], pa.string()))
    hashes, owner, place, left = [np.empty(0, np.uint64)], [], [], []
    for w in words_in(view, offsets, ALNUM, lower=True):
        hashes.append(span_hashes(w.data, w.start, w.end))
        for k, n in enumerate(np.diff(w.first).tolist()):
            name = rows[w.lo + k][0]
            owner.append(np.full(n, number["" if name is None else str(name)]))
            place.append(np.arange(n))
            left.append(np.arange(n, 0, -1))
    hashes = np.concatenate(hashes)
    vocabulary, words = np.unique(hashes, return_inverse=True)
    none = [np.empty(0, np.int64)]
    return Items(ids, vocabulary, words + 1, np.concatenate(none + owner),
                 np.concatenate(none + left), window, np.concatenate(none + place))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int,
                block_bytes: int) -> Iterator[tuple[int, object]]:
    """``(how many are left, block)`` of broadcast blocks of items, each of at most about
    ``block_bytes`` of text."""
    texts = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    context = benchmark.sparkSession.sparkContext
    for k in range(n):
        yield n - 1 - k, context.broadcast(_items(texts.where(part == k).collect(), window))


class Ranks:
    """Runs of words, and the rank of the first 1, 2, 4, .. words from each place."""

    def __init__(self, tokens: np.ndarray, left: np.ndarray):
        self.left, n = left, len(tokens)
        self.levels = [np.unique(tokens, return_inverse=True)[1] + 1]
        while n and 1 << (len(self.levels) - 1) < left.max():
            step, rank = 1 << (len(self.levels) - 1), self.levels[-1]
            after = np.zeros(n, np.int64)
            far = np.flatnonzero(left > step)
            after[far] = rank[far + step]
            self.levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1] + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the places have in common from there on."""
        off = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            open_ = np.flatnonzero((off < self.left[a]) & (off < self.left[b]))
            rank, here = self.levels[k], off[open_]
            same = open_[rank[a[open_] + here] == rank[b[open_] + here]]
            off[same] += np.minimum(1 << k, self.left[a[same]] - off[same])
        return off

    def key(self, place: np.ndarray, length: int) -> np.ndarray:
        """A number for the ``length`` words from each place, which has as many."""
        k = length.bit_length() - 1
        rank = self.levels[k]
        return rank[place] * (len(rank) + 1) + rank[place + length - (1 << k)]


def _covered(start: np.ndarray, size: int, left: np.ndarray):
    """The places that spans of ``size`` from ``start`` cover, their numbers, and the
    words from each covered place to the end of its run."""
    edge = np.zeros(len(left) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    number = np.full(len(left), -1, np.int64)
    number[place] = np.arange(len(place))
    if not len(place):
        return place, number, place
    closes = np.append(np.diff(place) > 1, True) | (left[place] == 1)
    ends = np.flatnonzero(closes)
    return place, number, ends[np.searchsorted(ends, np.arange(len(place)))] - np.arange(len(place)) + 1


class Shard:
    """The suffix array of one slice of documents."""

    def __init__(self, words, items: Items):
        self.n_words = np.diff(words.first)
        least = int(min(items.window, items.left[items.place == 0].min(initial=items.window)))
        hashes = span_hashes(words.data, words.start, words.end)
        number = np.searchsorted(items.vocabulary, hashes)
        number[number == len(items.vocabulary)] = 0
        known = (items.vocabulary[number] == hashes if len(items.vocabulary)
                 else np.zeros(len(hashes), bool))
        # Runs of known words within one text.
        opens = known.copy()
        opens[1:] &= ~known[:-1]
        heads = words.first[:-1][words.first[:-1] < words.first[1:]]
        opens[heads] = known[heads]
        closes = known.copy()
        closes[:-1] &= ~known[1:] | opens[1:]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        size = stop - start
        fit = size >= least
        start, size = start[fit], size[fit]
        n = int(size.sum())
        run = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        inner = np.arange(n) - first[run]
        self.source = start[run] + inner           # word of the slice
        self.left = size[run] - inner              # words to the run's end
        self.tokens = number[self.source] + 1
        self.order = self._sort()

    def _sort(self) -> np.ndarray:
        n = len(self.tokens)
        if not n:
            return np.empty(0, np.int64)
        rank = np.unique(self.tokens, return_inverse=True)[1] + 1
        step = 1
        while step < self.left.max():
            after = np.zeros(n, np.int64)
            far = np.flatnonzero(self.left > step)
            after[far] = rank[far + step]
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1] + 1
            step *= 2
        return np.argsort(rank, kind="stable")

    def _word(self, place: np.ndarray, depth: int) -> np.ndarray:
        """The word ``depth`` after the suffixes at these places of the array, 0 past its end."""
        at = self.order[place]
        inside = self.left[at] > depth
        return np.where(inside, self.tokens[np.where(inside, at + depth, 0)], 0)

    def _bound(self, lo, hi, word, depth, after: bool):
        lo, hi = lo.copy(), hi.copy()
        while True:
            going = np.flatnonzero(lo < hi)
            if not going.size:
                return lo
            mid = (lo[going] + hi[going]) // 2
            got = self._word(mid, depth)
            up = got <= word[going] if after else got < word[going]
            lo[going[up]] = mid[up] + 1
            hi[going[~up]] = mid[~up]

    def search(self, items: Items):
        """Yield ``(depth, suffixes, lo, hi)``: the test suffixes that match
        ``depth`` words, and their intervals."""
        live = np.arange(len(items.words))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.order))
        depth = 0
        while live.size:
            word = items.words[live + depth]
            low = self._bound(lo, hi, word, depth, after=False)
            high = self._bound(low, hi, word, depth, after=True)
            some = low < high
            live, lo, hi = live[some], low[some], high[some]
            depth += 1
            if live.size:
                yield depth, live, lo, hi
            longer = items.left[live] > depth
            live, lo, hi = live[longer], lo[longer], hi[longer]

    def _expand(self, lo, hi):
        """All places of the intervals, and the interval each belongs to."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        return self.order[lo[which] + np.arange(len(which))
                          - (np.cumsum(size) - size)[which]], which

    def hits(self, items: Items, text_of: np.ndarray, longest: bool = False):
        """Covered words, pairs of (text, item) with an occurring window, and
        ``(text, length, word, item, place)`` of the longest match of each text."""
        cover = np.zeros(len(text_of) + 1, np.int64)
        pairs = [np.empty(0, np.int64)]
        best = [np.empty((5, 0), np.int64)]
        for depth, suffix, lo, hi in self.search(items):
            if depth > items.window:
                break
            whole = (items.left[suffix] == depth) & (items.place[suffix] == 0)
            take = np.full(len(suffix), True) if depth == items.window else whole
            suffix, lo, hi = suffix[take], lo[take], hi[take]
            if not suffix.size:
                continue
            # Equal windows share an interval; each is expanded once.
            _, some, which = np.unique(lo, return_index=True, return_inverse=True)
            at, owner = self._expand(lo[some], hi[some])
            word = self.source[at]
            np.add.at(cover, word, 1)
            np.add.at(cover, word + depth, -1)
            here = np.unique(text_of[word] * len(some) + owner)
            known = np.unique(which * len(items.ids) + items.item[suffix])
            group, item = known // len(items.ids), known % len(items.ids)
            first = np.searchsorted(group, np.arange(len(some) + 1))
            n = np.diff(first)[here % len(some)]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.repeat(here // len(some), n) * len(items.ids)
                         + item[np.repeat(first[here % len(some)], n) + nth])
            if longest and depth < items.window:
                best.append(np.stack((text_of[word], np.full(len(at), depth), word,
                                      item[first[owner]], np.zeros(len(at), np.int64))))
            elif longest:
                best.append(self._extended(items, text_of, np.unique(at), np.unique(suffix)))
        best = np.concatenate(best, axis=1)
        best = best[:, np.lexsort((best[4], best[3], best[2], -best[1], best[0]))]
        best = best[:, np.unique(best[0], return_index=True)[1]]
        return np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(pairs)), best

    def _extended(self, items: Items, text_of: np.ndarray, at: np.ndarray, suffix: np.ndarray):
        """``(text, length, word, item, place)`` of the longest match of each text, whose
        windows start at the places ``at`` and in the test suffixes."""
        own, number, own_left = _covered(at, items.window, self.left)
        theirs, test, test_left = _covered(suffix, items.window, items.left)
        ranks = Ranks(np.concatenate((self.tokens[own], items.words[theirs])),
                      np.concatenate((own_left, test_left)))
        here, there = number[at], test[suffix] + len(own)
        # Among all suffixes in order, the nearest test suffix on either side.
        rank = ranks.levels[-1]
        there = there[np.argsort(rank[there], kind="stable")]
        after = np.searchsorted(rank[there], rank[here])
        length = np.maximum(ranks.common(here, there[np.maximum(after - 1, 0)]),
                            ranks.common(here, there[np.minimum(after, len(there) - 1)]))
        word = self.source[at]
        order = np.lexsort((word, -length, text_of[word]))
        one = order[np.unique(text_of[word][order], return_index=True)[1]]
        # Of the test suffixes that match so far the first item, and the first place there.
        of = theirs[there - len(own)]
        there = there[np.lexsort((items.place[of], items.item[of]))]
        found = np.zeros(len(one), np.int64)
        for size in np.unique(length[one]).tolist():
            long = there[ranks.left[there] >= size]
            keys, first = np.unique(ranks.key(long, size), return_index=True)
            some = np.flatnonzero(length[one] == size)
            at_key = np.searchsorted(keys, ranks.key(here[one[some]], size))
            found[some] = theirs[long[first[at_key]] - len(own)]
        return np.stack((text_of[word[one]], length[one], word[one], items.item[found],
                         items.place[found]))

    def longest(self, items: Items):
        """``(suffix, length, lo, hi)`` of the longest match of each test suffix."""
        best = np.zeros((3, len(items.words)), np.int64)
        for depth, suffix, lo, hi in self.search(items):
            best[:, suffix] = np.full(len(lo), depth), lo, hi
        return best


def _hits(column: pa.Array, items: Items, longest: bool = False) -> pa.Array:
    view, offsets = utf8(column)
    parts = []
    for w in words_in(view, offsets, ALNUM, lower=True):
        text_of = w.text_of()
        shard = Shard(w, items)
        covered, pairs, best = shard.hits(items, text_of, longest)
        n = w.hi - w.lo
        opens, closes = covered.copy(), covered.copy()
        heads = w.first[:-1][w.first[:-1] < w.first[1:]]
        opens[1:] &= ~covered[:-1]
        opens[heads] = covered[heads]
        closes[:-1] &= ~covered[1:] | opens[1:]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        base = w.first[:-1][text_of[start]]
        spans = pa.ListArray.from_arrays(
            np.concatenate(([0], np.cumsum(np.bincount(text_of[start], minlength=n)))).astype(np.int32),
            pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - base)],
                                       ["start", "stop"]))
        many = max(len(items.ids), 1)
        names = pa.ListArray.from_arrays(
            np.concatenate(([0], np.cumsum(np.bincount(pairs // many, minlength=n)))).astype(np.int32),
            pa.array([items.ids[k] for k in (pairs % many).tolist()], pa.string()))
        counts = np.bincount(text_of[covered], minlength=n)
        text, length, word, item, place = best
        match = pa.StructArray.from_arrays(
            [pa.array(length), pa.array(word - w.first[:-1][text]),
             pa.array([items.ids[k] for k in item.tolist()], pa.string()), pa.array(place)],
            ["length", "start", "item", "item_start"])
        which = np.full(n, -1, np.int64)
        which[text] = np.arange(len(text))
        match = match.take(pa.array(which, mask=which < 0))
        parts.append(pa.StructArray.from_arrays(
            [pa.array(shard.n_words.astype(np.int64)), pa.array(counts.astype(np.int64)),
             spans, names, match], ["n_words", "n_hit", "spans", "items", "longest"]))
    if not parts:
        return _hits(pa.array([""]), items)[:0]
    return pa.concat_arrays(parts)


def _hits_of(text: Column, block, longest: bool = False) -> Column:
    text_batches()

    @arrow_udf(HITS)
    def suffix_hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield _hits(column, block.value, longest)

    return suffix_hits(text)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
            text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
            window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document ``(id, n_words, n_hit, spans, items, longest)``.

    ``spans`` are the merged word ranges covered by occurring windows, ``items``
    the sorted ids of the items they are from.  ``longest`` is the longest run of
    words that the document and an item have in common and that holds an occurring
    window: ``length``, ``start`` in the document, ``item`` and ``item_start``; of
    equally long ones the first in the document, then the first item and place
    there; null without hits.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    folder, passes = None, []
    # One pass a block; only documents with hits are kept beside the first.
    key = [F.col("id"), F.xxhash64("text").alias("print"), F.octet_length("text").alias("size")]
    for left, block in item_blocks(benchmark, item_col, item_text_col, window, block_bytes):
        hit = _hits_of(F.col("text"), block, longest=True).alias("hit")
        if not left and not passes:
            return rows.select("id", hit).select("id", "hit.*")
        folder = folder or work_folder(docs.sparkSession)
        passes.append(settle(rows.select(*key, hit).select("id", "print", "size", "hit.*"), folder))
        block.unpersist()
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p.where("n_hit > 0"))
    merged = (found.where("n_hit > 0").groupBy("id", "print", "size")
              .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                   F.min(F.struct((-F.col("longest.length")).alias("less"), "longest.start",
                                  "longest.item", "longest.item_start")).alias("first")))
    merged = merged.withColumn("spans", F.aggregate(
        "spans", F.expr("cast(array() AS array<struct<start:bigint, stop:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(done, F.lit(-1))["stop"], s["stop"]).alias("stop")))))
        .otherwise(F.concat(done, F.array(s)))))
    merged = merged.withColumn("n_hit", F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"]))
    merged = merged.withColumn("longest", F.struct(
        (-F.col("first.less")).alias("length"), "first.start", "first.item", "first.item_start"))
    merged = merged.drop("first").select(*[F.col(c).alias(f"m_{c}") for c in merged.columns if c != "first"])
    base = passes[0]
    on = (base["id"].eqNullSafe(F.col("m_id")) & base["print"].eqNullSafe(F.col("m_print"))
          & base["size"].eqNullSafe(F.col("m_size")))
    return base.join(merged, on, "left").select(
        "id", "n_words", F.coalesce("m_n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("m_spans", "spans").alias("spans"), F.coalesce("m_items", "items").alias("items"),
        F.col("m_longest").alias("longest"))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    folder = None
    for left, block in item_blocks(benchmark, item_col, item_text_col, window, block_bytes):
        docs = docs.where(_hits_of(F.col(text_col), block)["n_hit"] == 0)
        if left:
            folder = folder or work_folder(docs.sparkSession)
            docs = settle(docs, folder)
            block.unpersist()
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", window: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each suffix of a test item that matches a full window somewhere:
    ``(item, item_start, length, id, start)``, its longest verbatim match and of
    that the smallest document id and place (ids must be numbers)."""
    text_batches()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = None
    for _, block in item_blocks(benchmark, item_col, item_text_col, window, block_bytes):
        part = rows.mapInArrow(lambda batches, block=block: _longest(batches, block.value),
                               "item string, item_start bigint, length bigint, id bigint, start bigint")
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("length", (-F.col("id")).alias("i"), (-F.col("start")).alias("s")))
    return (out.groupBy("item", "item_start").agg(best.alias("b"))
            .select("item", "item_start", "b.length", (-F.col("b.i")).alias("id"),
                    (-F.col("b.s")).alias("start")))


def _longest(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        view, offsets = utf8(batch.column("text"))
        for w in words_in(view, offsets, ALNUM, lower=True):
            shard, text_of = Shard(w, items), w.text_of()
            length, lo, hi = shard.longest(items)
            enough = np.flatnonzero((length >= items.window)
                                    | ((length == items.left) & (items.place == 0) & (length > 0)))
            if not enough.size:
                continue
            at, which = shard._expand(lo[enough], hi[enough])
            word = shard.source[at]
            text = text_of[word]
            # Of each suffix the smallest document and place in this shard.
            order = np.lexsort((word, ids[w.lo + text], which))
            one = order[np.unique(which[order], return_index=True)[1]]
            suffix = enough[which[one]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([items.ids[k] for k in items.item[suffix].tolist()], pa.string()),
                 pa.array(items.place[suffix].astype(np.int64)), pa.array(length[suffix]),
                 pa.array(ids[w.lo + text[one]].astype(np.int64)),
                 pa.array((word[one] - w.first[text[one]]).astype(np.int64))],
                ["item", "item_start", "length", "id", "start"])
