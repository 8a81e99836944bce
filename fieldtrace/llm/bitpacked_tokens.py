"""Token ids in fixed-width bit-packed files.

Each id takes the fewest bits that hold the vocabulary.  A file is

    magic, version, bits, ids per block       (16 bytes)
    number of documents, ids, blocks          (3 x int64)
    document ids, with a null marker each     (int64 and uint8 per document)
    ids of each document                      (int64 per document)
    byte offset of each block's words         (int64 per block)
    blocks of little-endian 32-bit words

A block holds ``BLOCK_IDS`` ids (the last one filled with zeros), 32 ids in
``bits`` words, so numpy packs and unpacks all groups of a block at once, and
any id range is read by seeking to its blocks.

Files hold documents in ascending id order (nulls first), file after file.  The
rows are dealt to tasks by ranges of (id, hash of the text), so rows that share an
id spread as well, and a file is closed after a fixed number of ids.  Files are
written under the name of the task attempt; the manifest, itself written out,
lists those that count, so lost executors and repeated attempts do no harm.

Edge cases: a null text counts as empty and has the end id alone; rows that
share an id follow each other, ordered by a hash of the text, then by text.  Empty tables give an empty
manifest.  Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import row_slices, settle, text_batches, utf8, work_folder
from .wordbytes import SLICE_BYTES, span_hashes

BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 24
END_ID = 0
# Pieces of text whose ids a worker remembers, those of them held apart until they are
# sorted in, and those encoded at a time.
REMEMBERED = 800_000
RECENT = 60_000
TOGETHER = 100
_HEAD = 40
_MAGIC = b"BITS"

MANIFEST = "part int, file int, path string, docs bigint, ids bigint"


# -- packing -------------------------------------------------------------------

def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids below ``vocabulary``."""
    if not 0 < vocabulary <= 1 << 32:
        raise ValueError("the vocabulary must have 1 to 2**32 ids")
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """The ids (below ``2**bits``) as 32-bit words, 32 ids in ``bits`` words."""
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    groups = np.zeros((-(-len(ids) // 32), 32), np.uint64)
    groups.reshape(-1)[:len(ids)] = ids
    words = np.zeros((len(groups), bits), np.uint64)
    for k in range(32):
        word, shift = divmod(k * bits, 32)
        value = groups[:, k] << np.uint64(shift)
        words[:, word] |= value & np.uint64(0xFFFFFFFF)
        if shift + bits > 32:
            words[:, word + 1] |= value >> np.uint64(32)
    return words.astype("<u4").reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed words."""
    words = words.reshape(-1, bits).astype(np.uint64)
    ids = np.empty((len(words), 32), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(32):
        word, shift = divmod(k * bits, 32)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 32:
            value |= words[:, word + 1] << np.uint64(32 - shift)
        ids[:, k] = value & mask
    return ids.reshape(-1)[:n]


# -- files ---------------------------------------------------------------------

def _open(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def write_file(path: str, doc_ids: list, counts: np.ndarray, chunks: list[np.ndarray],
               bits: int) -> None:
    """One file; ``chunks`` are the ids of all its documents, in order."""
    total = int(counts.sum())
    blocks = -(-total // BLOCK_IDS)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    size = BLOCK_IDS // 32 * bits * 4
    data_at = _HEAD + len(names) * 17 + blocks * 8
    fs, place = _open(path)
    with fs.open_output_stream(place) as out:
        out.write(_MAGIC + np.array([1, bits, BLOCK_IDS], "<u4").tobytes())
        out.write(np.array([len(names), total, blocks], "<i8").tobytes())
        out.write(names.tobytes() + known.tobytes() + counts.astype("<i8").tobytes())
        out.write((data_at + size * np.arange(blocks)).astype("<i8").tobytes())
        rest = np.empty(0, np.uint32)
        for chunk in [*chunks, None]:
            if chunk is not None:
                rest = np.concatenate((rest, chunk))
                whole = len(rest) // BLOCK_IDS * BLOCK_IDS
            else:
                rest = np.concatenate((rest, np.zeros(-len(rest) % BLOCK_IDS, np.uint32)))
                whole = len(rest)
            if whole:
                out.write(pack(rest[:whole], bits).tobytes())
                rest = rest[whole:]


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str):
        self.fs, self.place = _open(path)
        with self.fs.open_input_file(self.place) as file:
            head = file.read_at(_HEAD, 0)
            if head[:4] != _MAGIC:
                raise ValueError(f"not a token file: {path}")
            _, self.bits, self.block = np.frombuffer(head[4:16], "<u4").tolist()
            docs, self.n_ids, blocks = np.frombuffer(head[16:], "<i8").tolist()
            body = file.read_at(docs * 17 + blocks * 8, _HEAD)
        self.known = np.frombuffer(body, np.uint8, docs, docs * 8).astype(bool)
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        self.counts = np.frombuffer(body[docs * 9:docs * 17], "<i8")
        self.blocks = np.frombuffer(body[docs * 17:], "<i8")
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` of the file; reads only the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        size = self.block // 32 * self.bits * 4
        with self.fs.open_input_file(self.place) as file:
            data = file.read_at(int(self.blocks[last] - self.blocks[first]) + size,
                                int(self.blocks[first]))
        ids = unpack(np.frombuffer(data, "<u4"), self.bits, (last - first + 1) * self.block)
        return ids[start - first * self.block:stop - first * self.block]

    def slices(self, most: int = 1 << 20):
        """``(from, to, ids)`` for consecutive documents of about ``most`` ids."""
        at, n = 0, len(self.counts)
        while at < n:
            to = int(np.searchsorted(self.starts, self.starts[at] + most, "right")) - 1
            to = min(max(to, at + 1), n)
            yield at, to, self.ids(int(self.starts[at]), int(self.starts[to]))
            at = to


# -- encoding ------------------------------------------------------------------

# Byte classes: 0 others, 1 space, 2 newline, 3 letters, 4 digits, 5 ASCII marks.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 5
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[0x20], _CLASS[0x0A] = 1, 2
_APOSTROPHE = 0x27
# Blanks beside the space and the newline; the others are not ASCII.
_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)),
         "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_encoders: dict[str, Encoder] = {}


def _plain(text: str) -> bool:
    return not ("  " in text or " \n" in text or "\n\n" in text or "<|" in text
                or any(b in text for b in _BLANKS)
                or (not text.isascii() and any(b in text for b in _WIDE)))


class _Known:
    """Ids of pieces already encoded: sorted 64-bit keys, a check, and a range of ``ids``."""

    def __init__(self):
        self.key = np.empty(0, np.uint64)
        self.check = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int32)
        self.used = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key stands, and whether it does."""
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        if not len(self.key):
            return at, np.zeros(len(key), bool)
        return at, (self.key[at] == key) & (self.check[at] == check)

    def add(self, key, check, count, used, ids):
        """Put new pieces (``ids`` one after another) among the known ones."""
        at = np.searchsorted(self.key, key)
        first = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        for name, new in (("key", key), ("check", check), ("first", first), ("count", count),
                          ("used", used)):
            setattr(self, name, np.insert(getattr(self, name), at, new))
        self.ids = np.concatenate((self.ids, ids))

    def part(self, keep: np.ndarray):
        """Keys, checks, counts, uses and ids of some pieces."""
        return (self.key[keep], self.check[keep], self.count[keep], self.used[keep],
                _spread(self.ids, self.first[keep], self.count[keep]))


def _spread(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``values[first:first + count]`` of every pair, one after another."""
    last = np.cumsum(count, dtype=np.int64)
    return values[np.repeat(first - (last - count), count)
                  + np.arange(last[-1] if len(last) else 0)]


class Encoder:
    """Encodes texts with a byte-level BPE file, remembering what frequent pieces give.

    Such a tokenizer first splits a text, always before a space that a word
    follows, around a single newline, and where letters, digits and marks meet
    (but not after an apostrophe).  A text whose blanks are all of these kinds is
    cut there and each distinct piece is encoded once; any other text is one
    piece.  Pieces are told apart by 128 bits of hash.

    New pieces go to the tokenizer many at a time in one text, in which it splits
    between them by the same rule; the bytes that each id stands for say which
    ids are whose.
    """

    def __init__(self, path: str):
        # One thread: the tasks are what runs in parallel.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # A byte-level vocabulary writes each byte as one character.
        self.width = np.zeros(self.vocabulary, np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[k] = len(token)
        # Older pieces, and those of the last slices, which are cheaper to add to.
        self.known, self.recent = _Known(), _Known()

    def _forget(self):
        """Move recent pieces to the older ones; if these are too many, keep the half
        that was met in most slices."""
        if len(self.recent.key) > RECENT:
            self.known.add(*self.recent.part(np.arange(len(self.recent.key))))
            self.recent = _Known()
        if len(self.known.key) > REMEMBERED or len(self.known.ids) > 8 * REMEMBERED:
            keep = np.sort(np.argsort(-self.known.used, kind="stable")[:REMEMBERED // 2])
            # Very long pieces are not worth their room.
            keep = keep[self.known.count[keep] <= 64]
            part, self.known = self.known.part(keep), _Known()
            self.known.add(*part)
            self.known.used[:] = 0

    def _cuts(self, data: np.ndarray, begins: np.ndarray, plain: np.ndarray) -> np.ndarray:
        kind = _CLASS[data]
        cut = (kind == 1) | (kind == 2)
        before, now = kind[:-1], kind[1:]
        cut[1:] |= (before == 2) | ((before >= 3) & (now >= 3) & (before != now)
                                    & (data[:-1] != _APOSTROPHE))
        for k in np.flatnonzero(~plain):
            cut[begins[k]:begins[k + 1]] = False
        cut[begins[:-1]] = True
        return np.flatnonzero(cut)

    def _together(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Ids and their number for pieces that may stand side by side in one text:
        those without a space in front get a newline there, which is a piece itself."""
        lead = (data[start] != 0x20).astype(np.int64)
        size = end - start + lead
        last = np.cumsum(size)
        first = last - size
        joined = data[np.clip(np.repeat(start - lead - first, size) + np.arange(last[-1]),
                              0, None)]
        joined[first[lead == 1]] = 0x0A
        raw, found, counts = joined.tobytes(), [], []
        for at in range(0, len(start), TOGETHER):
            to = min(at + TOGETHER, len(start))
            text = raw[first[at]:last[to - 1]].decode()
            ids = np.array(self.tokenizer.encode_batch_fast(
                [text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.width[ids]) + first[at]
            edge = np.searchsorted(ends, last[at:to]) + 1
            own = np.diff(edge, prepend=0) - lead[at:to]
            if (ends[edge - 1] != last[at:to]).any() or (own < 1).any():
                raise ValueError("the tokenizer does not split between pieces")
            keep = np.ones(len(ids), bool)
            keep[np.concatenate(([0], edge[:-1]))[lead[at:to] == 1]] = False
            found.append(ids[keep])
            counts.append(own)
        return np.concatenate(found), np.concatenate(counts)

    def _learn(self, data: np.ndarray, start, end, plain, key, check):
        """Encode new pieces and remember them."""
        first = data[start]
        # A lone blank, or a text with rare blanks, is encoded by itself.
        side = plain & (first != 0x0A) & ((first != 0x20) | (end - start > 1))
        order = np.argsort(~side, kind="stable")
        n = int(side.sum())
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        if n:
            some, count = self._together(data, start[order[:n]], end[order[:n]])
            ids.append(some)
            counts.append(count)
        rest = order[n:]
        if len(rest):
            got = self.tokenizer.encode_batch_fast(
                [data[a:b].tobytes().decode() for a, b in zip(start[rest], end[rest])],
                add_special_tokens=False)
            ids += [np.array(e.ids, np.uint32) for e in got]
            counts.append(np.array([len(e.ids) for e in got], np.int64))
        ids, count = np.concatenate(ids), np.concatenate(counts)
        begin = np.cumsum(count) - count
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.recent.add(key, check, count[back].astype(np.int32), np.zeros(len(key), np.int32),
                        _spread(ids, begin[back], count[back]))

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All ids of a slice of the texts in one array, and the number of each."""
        view, offsets = utf8(column)
        for lo, hi in row_slices(offsets, SLICE_BYTES):
            self._forget()
            at = offsets[lo:hi + 1].tolist()
            texts = [bytes(view[a:b]) for a, b in zip(at, at[1:])]
            data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
            begins = offsets[lo:hi + 1] - offsets[lo] + np.arange(hi - lo + 1)
            plain = np.fromiter((_plain(t.decode()) for t in texts), bool, hi - lo)
            cuts = self._cuts(data, begins, plain)
            text_of = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(cuts, begins)))
            end = np.minimum(np.append(cuts[1:], len(data)), begins[text_of + 1] - 1)
            some = cuts < end
            start, end, text_of = cuts[some], end[some], text_of[some]
            keys = span_hashes(data, start, end)
            checks = span_hashes(data, start, end, 1)
            key, one, which = np.unique(keys, return_index=True, return_inverse=True)
            check = checks[one]
            if (check[which] != checks).any():
                raise ValueError("two pieces share a hash")
            old, is_old = self.known.find(key, check)
            place, known = self.recent.find(key, check)
            new = ~(known | is_old)
            if new.any():
                self._learn(data, start[one[new]], end[one[new]], plain[text_of[one[new]]],
                            key[new], check[new])
                place, known = self.recent.find(key, check)
                if not (known | is_old).all():
                    raise ValueError("two pieces share a hash")
            self.known.used[old[is_old]] += 1
            self.recent.used[place[known]] += 1
            first, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            first[is_old], count[is_old] = self.known.first[old[is_old]], self.known.count[old[is_old]]
            first[known] = self.recent.first[place[known]] + len(self.known.ids)
            count[known] = self.recent.count[place[known]]
            count = count[which]
            ids = _spread(np.concatenate((self.known.ids, self.recent.ids)), first[which], count)
            yield ids, np.bincount(text_of, count, hi - lo).astype(np.int64)


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int):
    """The ids with ``end_id`` after each document."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


# -- Spark ---------------------------------------------------------------------

def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents; returns the manifest, one row per file.

    Ids of documents must be whole numbers.  A file is closed once it has
    ``file_ids`` ids, so a task holds no more than that and one slice.  Runs jobs.
    """
    folder = folder or work_folder(docs.sparkSession)
    text_batches()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        task = TaskContext.get()
        files, held = 0, 0
        names, counts, chunks = [], [], []

        def close() -> pa.RecordBatch:
            n = np.concatenate(counts)
            path = (f"{folder}/part-{task.partitionId():06d}-{files:04d}"
                    f"-{task.taskAttemptId()}-{uuid.uuid4().hex}.bits")
            write_file(path, names, n, chunks, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int32()), pa.array([files], pa.int32()),
                 pa.array([path]), pa.array([len(names)], pa.int64()),
                 pa.array([int(n.sum())], pa.int64())],
                ["part", "file", "path", "docs", "ids"])

        for batch in batches:
            own, at = batch.column("id").to_pylist(), 0
            for ids, n in enc.encode(batch.column("text")):
                ids, n = with_end(ids, n, end_id)
                names += own[at:at + len(n)]
                at += len(n)
                chunks.append(ids.astype(np.uint16) if bits <= 16 else ids)
                counts.append(n)
                held += len(ids)
                if held >= file_ids:
                    yield close()
                    files, held = files + 1, 0
                    names, counts, chunks = [], [], []
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text"), "text"]
    placed = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return settle(placed.mapInArrow(write, MANIFEST), folder)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document, read from the files.

    ``start`` counts the ids of all documents before it; ``ids`` are its ids as
    little-endian unsigned 32-bit numbers.
    """
    # One row per file, so this window is small.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before),
                                                     F.lit(0).cast("bigint")))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                file = TokenFile(path)
                for lo, hi, ids in file.slices():
                    starts = file.starts[lo:hi + 1]
                    ends = (starts - starts[0]) * 4
                    data = pa.Array.from_buffers(
                        pa.large_binary(), hi - lo,
                        [None, pa.py_buffer(ends.astype(np.int64).tobytes()),
                         pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[lo:hi], mask=~file.known[lo:hi]),
                         pa.array(base + starts[:-1]), pa.array(file.counts[lo:hi]), data],
                        ["id", "start", "n_tokens", "ids"])

    return files.select("path", "before").repartition(n).mapInArrow(
        read, "id bigint, start bigint, n_tokens bigint, ids binary")
