"""Words of whole text batches as numpy positions in their UTF-8 bytes.

A batch is laid out as one byte buffer, a newline after each text, so that no
word spans two texts.  Both word classes used here can be told byte by byte,
because every byte of a non-ASCII character belongs to a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .frames import row_slices

SLICE_BYTES = 500_000

_ALL = np.arange(256)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
# [^\x20\x09-\x0D]+
NOT_BLANK = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, on lower-cased text
ALNUM = (((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A))
         | (_ALL >= 0x80))

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, list[np.ndarray]] = {}


@dataclass
class Words:
    """Words of texts ``lo:hi`` of a batch; word ``i`` is ``data[start[i]:end[i]]``."""
    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray   # of each text its first word, then the number of words

    def text_of(self) -> np.ndarray:
        """The number of the text (from 0 in this slice) of each word."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def words_in(view: memoryview, offsets: np.ndarray, kind: np.ndarray, lower: bool,
             most: int = SLICE_BYTES):
    """Yield :class:`Words` for consecutive slices of a batch."""
    for lo, hi in row_slices(offsets, most):
        at = offsets[lo:hi + 1].tolist()
        data = np.frombuffer(b"\n".join([view[a:b] for a, b in zip(at, at[1:])]) + b"\n", np.uint8)
        if lower:
            data = LOWER[data]
        inside = kind[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside.size and inside[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        begins = offsets[lo:hi + 1] - offsets[lo] + np.arange(hi - lo + 1)
        yield Words(lo, hi, data, start, end, np.searchsorted(start, begins))


def joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, with their new starts and ends."""
    size = words.end - words.start
    start = np.cumsum(size + 1) - size - 1
    keep = np.zeros(len(words.data), bool)
    delta = np.zeros(len(words.data) + 1, np.int8)
    delta[words.start] = 1
    delta[np.minimum(words.end + 1, len(words.data))] -= 1
    keep = np.cumsum(delta[:-1], dtype=np.int8).astype(bool)
    text = words.data.copy()
    text[words.end] = 0x20
    return text[keep].tobytes(), start, start + size


def _power(n: int, which: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, for ``n`` bytes."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(n + 1, SLICE_BYTES + 65_536)
        _powers[which] = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[which].append(np.multiply.accumulate(steps))
    return _powers[which]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray,
                which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they lie.

    ``which`` chooses one of two hashes that can be taken together.
    """
    up, down = _power(len(data), which)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]
               + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
