"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and
international phone numbers.  The random field adds what they miss: phone numbers
without a country code, addresses that are spelt out, and secrets.

The field labels tokens (runs of letters and digits, or single marks) from their
shape: kind of characters, length, a few cue words, and the blank before them.
A label's score at a token is the sum of three table entries, for the shapes of
the token and of both neighbours, plus a score for each pair of labels in a row.
It is fitted to a small labelled table by gradient steps.

Decoding is Viterbi in numpy batches over the stretches that need it.  A token
whose score for "outside" beats every other label by more than any change of
neighbouring pair scores could bring back is outside on every best path.  Such
tokens cut the texts, and what lies between them is decoded exactly.

Edge cases: a null text counts as empty and has no spans.  Rows are judged one by
one; ids, repeated rows and other columns do not matter.  Very long texts are read
whole, in time and memory proportional to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .frames import row_slices, text_batches, utf8
from .wordbytes import LOWER, SLICE_BYTES, span_hashes

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("outside", *KINDS)
SPANS = "array<struct<kind:string, start:bigint, stop:bigint, source:string>>"

# --- fixed values: the base patterns -------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# -------------------------------------------------------------------------------


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _card(text: str) -> bool:
    if len(text) > 40:      # more than 19 digits, whatever stands between them
        return False
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


# The same matches in linear time.  A run of digits or of letters that cannot match
# from its first character cannot match from a later one, so only run starts are
# tried, and an address is sought from its "@" outwards.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_FOUR = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    back, n, free = text[::-1], len(text), 0
    at = text.find("@")
    while at >= 0:
        # The characters before the "@", as far as the last match.
        start = n - _LOCAL.match(back, n - at, n - free).end()
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, by kind and start."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _FOUR.finditer(text) if _ip(m[0])]
    found += [("card", *m.span()) for m in _CHAIN.finditer(text) if _card(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text)
                  if 9 <= len(_digits(m[0])) <= 15]
    return found


# -- tokens and shapes ---------------------------------------------------------

_ALL = np.arange(256)
_UPPER = (_ALL >= 0x41) & (_ALL <= 0x5A)
_DIGIT = (_ALL >= 0x30) & (_ALL <= 0x39)
_HEX = _DIGIT | ((_ALL >= 0x61) & (_ALL <= 0x66)) | ((_ALL >= 0x41) & (_ALL <= 0x46))
_WIDE = _ALL >= 0x80
_WORD = _DIGIT | _UPPER | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | _WIDE
_BLANK = (_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
# Shortest lengths of the length classes.
_LENGTHS = np.array([1, 2, 3, 4, 5, 7, 9, 12, 16, 24, 32])
CUES = ("at", "call", "card", "com", "dot", "email", "fax", "ip", "key", "mail", "mobile", "net",
        "org", "password", "phone", "secret", "tel", "token")
_CLASSES = 6          # lower, capital first, other letters, digits, hexadecimal, mixed
_GAPS = 3             # none, blank, line or text begins
_MARKS = _CLASSES * len(_LENGTHS)
SHAPES = (_MARKS + 128 + len(CUES)) * _GAPS
# The shape beyond a text's ends.
EDGE = SHAPES
# Corpora hold far less personal data than the labelled table, so words and common
# marks lean to outside beforehand: by these scores as the token itself, the one
# before and the one after.
PRIOR = (4.0, 2.5, 2.5)
# Label rows decoded together have at most so many cells; longer stretches are decoded
# in blocks of their own.
CELLS = 400_000
LONG = 2_000
_COMMON = ",;:!?|#$%&*<>{}[]\"'~^`"
_CUE_KEYS = None


def _cue_keys():
    global _CUE_KEYS
    if _CUE_KEYS is None:
        data = np.frombuffer(" ".join(CUES).encode(), np.uint8)
        size = np.array([len(c) for c in CUES])
        start = np.cumsum(size + 1) - size - 1
        keys = span_hashes(data, start, start + size)
        order = np.argsort(keys)
        _CUE_KEYS = keys[order], order
    return _CUE_KEYS


def _plain_shapes() -> np.ndarray:
    shape = np.arange(SHAPES + 1) // _GAPS
    plain = shape < 3 * len(_LENGTHS)
    for mark in _COMMON:
        plain |= shape == _MARKS + ord(mark)
    plain[EDGE] = True
    return plain


def tokens(data: np.ndarray, begins: np.ndarray):
    """``(start, end, shape, text)`` of the tokens of newline-ended texts."""
    word = _WORD[data]
    blank = _BLANK[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    opens |= ~word & ~blank
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    closes |= ~word & ~blank
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size = end - start

    def within(kind):
        sums = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int32)))
        return sums[end] - sums[start]

    digits, upper, hexes = within(_DIGIT), within(_UPPER), within(_HEX)
    first = data[start]
    cls = np.where(upper == 0, 0, np.where((upper == 1) & _UPPER[first], 1, 2))
    cls = np.where(digits > 0, np.where(digits == size, 3, np.where(hexes == size, 4, 5)), cls)
    shape = cls * len(_LENGTHS) + np.searchsorted(_LENGTHS, size, "right") - 1
    mark = ~_WORD[first]
    shape = np.where(mark, _MARKS + np.minimum(first, 127), shape)
    cue = np.flatnonzero((digits == 0) & (size <= 8) & (size >= 2) & ~mark)
    keys, number = _cue_keys()
    hashes = span_hashes(LOWER[data], start[cue], end[cue])
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    shape[cue[hit]] = _MARKS + 128 + number[at[hit]]
    text = np.searchsorted(begins, start, "right") - 1
    before = data[np.maximum(start - 1, 0)]
    gap = np.where(_BLANK[before], np.where(before == 0x0A, 2, 1), 0)
    gap[start == begins[text]] = 2
    return start, end, shape * _GAPS + gap, text


# -- the field -----------------------------------------------------------------

class Field:
    """Score tables: for a token's own, previous and next shape, and label pairs."""

    def __init__(self, own, before, after, pairs):
        self.own, self.before, self.after, self.pairs = own, before, after, pairs
        # How far "outside" (label 0) is ahead of the best other label.
        self.ahead = [t[:, 0] - t[:, 1:].max(1) for t in (own, before, after)]
        p = pairs
        n = len(p)
        # What the pairs around a token can give another label at most.
        self.swing = max(p[a, y] + p[y, b] - p[a, 0] - p[0, b]
                         for a in range(n) for b in range(n) for y in range(1, n))

    def scores(self, shape, before, after):
        return self.own[shape] + self.before[before] + self.after[after]

    def decode(self, shape: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best label of each token; exact."""
        n = len(shape)
        labels = np.zeros(n, np.int8)
        if not n:
            return labels
        same = text[1:] == text[:-1]
        before = np.concatenate(([EDGE], np.where(same, shape[:-1], EDGE)))
        after = np.concatenate((np.where(same, shape[1:], EDGE), [EDGE]))
        sure = (self.ahead[0][shape] + self.ahead[1][before] + self.ahead[2][after]) > self.swing
        open_ = np.flatnonzero(~sure)
        if not open_.size:
            return labels
        breaks = np.flatnonzero((np.diff(open_) > 1) | (text[open_[1:]] != text[open_[:-1]])) + 1
        first = np.concatenate(([0], breaks))
        size = np.diff(np.append(first, len(open_)))
        scores = self.scores(shape[open_], before[open_], after[open_])
        # A text's end counts as a cut, too: outside goes before and after it.
        order = np.argsort(size, kind="stable")
        many = int(np.searchsorted(size[order], LONG, "right"))
        for lo, hi in _groups(size[order[:many]], CELLS):
            some = order[lo:hi]
            labels_of = _viterbi(scores, first[some], size[some], self.pairs)
            inside = np.arange(labels_of.shape[1]) < size[some][:, None]
            labels[open_[(first[some][:, None] + np.arange(labels_of.shape[1]))[inside]]] = labels_of[inside]
        for k in order[many:].tolist():
            own = slice(first[k], first[k] + size[k])
            labels[open_[own]] = _viterbi_long(scores[own], self.pairs)
        return labels


def _groups(size: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Ranges of ascending sizes whose number times the largest is at most ``cells``."""
    at = 0
    while at < len(size):
        most = (np.arange(1, len(size) - at + 1)) * size[at:]
        to = at + max(1, int(np.searchsorted(most, cells, "right")))
        yield at, to
        at = to


def _viterbi_long(scores: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best labels of one long stretch.

    It is cut into blocks of about the square root of its length.  All blocks are
    decoded at once for every label that may stand before them, then the best of
    these is chosen from block to block.
    """
    length, n = scores.shape
    size = int(np.ceil(np.sqrt(length)))
    blocks = -(-length // size)
    # The last block is filled with tokens that are outside for sure and cost nothing.
    spare = np.full((blocks * size - length, n), -np.inf)
    spare[:, 0] = 0
    scores = np.concatenate((scores, spare)).reshape(blocks, size, n)
    # After the last token comes outside, as after any stretch; then nothing more counts.
    real = length - (blocks - 1) * size
    end, rest = np.full((n, n), -np.inf), np.full((n, n), -np.inf)
    end[:, 0], rest[0, 0] = pairs[:, 0], 0
    best = pairs[None] + scores[:, 0][:, None, :]           # block, label before, label
    back = np.zeros((size, blocks, n, n), np.int8)
    for t in range(1, size):
        ways = best[:, :, :, None] + pairs
        if t >= real:
            ways[-1] = best[-1][:, :, None] + (end if t == real else rest)
        back[t] = ways.argmax(2)
        best = ways.max(2) + scores[:, t][:, None, :]
    now, came = np.full(n, -np.inf), np.zeros((blocks, n), np.int8)
    now[0] = 0
    for k in range(blocks):
        ways = now[:, None] + best[k]
        came[k], now = ways.argmax(0), ways.max(0)
    last = np.zeros(blocks, np.int8)
    before = np.zeros(blocks, np.int8)
    label = int((now if len(spare) else now + pairs[:, 0]).argmax())
    for k in range(blocks - 1, -1, -1):
        last[k], before[k] = label, came[k, label]
        label = int(before[k])
    out, at = np.zeros((blocks, size), np.int8), np.arange(blocks)
    label = last
    for t in range(size - 1, -1, -1):
        out[:, t] = label
        label = back[t, at, before, label]
    return out.reshape(-1)[:length]


def _viterbi(scores, first, size, pairs):
    """Best label rows of stretches that lie between outside tokens."""
    longest = int(size.max())
    n = pairs.shape[0]
    best = scores[first] + pairs[0]
    back = np.zeros((longest, len(first), n), np.int8)
    for t in range(1, longest):
        going = np.flatnonzero(size > t)
        ways = best[going][:, :, None] + pairs[None]
        back[t, going] = ways.argmax(1)
        best[going] = ways.max(1) + scores[first[going] + t]
    labels = np.zeros((len(first), longest), np.int8)
    now = (best + pairs[:, 0]).argmax(1)
    for t in range(longest - 1, -1, -1):
        live = size > t
        labels[live, t] = now[live]
        now = np.where(live, back[t, np.arange(len(first)), now], now)
    return labels


# -- the labelled table --------------------------------------------------------

# Each slot of a line is filled with made-up values of its kind; all other text is outside.
_LINES = (
    "Write to {email} or call {phone} today.", "Mail: {email}", "Email {email}, thanks.",
    "You can reach me at {email} after nine.", "phone {phone}", "Tel. {phone}, ask for Ana.",
    "Call {phone} and wait there.", "My mobile is {phone}.", "Fax: {phone}",
    "The host {ip} is down.", "ip {ip} was seen at the gate", "ping {ip}, then {ip}",
    "card {card} exp 04/27", "Paid with {card} on Monday.", "Card: {card}.",
    'token = "{secret}"', "key: {secret}", "secret={secret}", 'password = "{secret}" here',
    'va token = "{secret}" mirro', "und {phone} rul {ip} die", "da {card} ost {email} il.",
    "some*** {phone}%%% or$$$ {email}&&& to###", 'to&&& token = "{secret}"### {card}$$$ la,&&&',
)


def _made_up(kind: str, rng: np.random.Generator) -> str:
    """A value of a kind, drawn at random."""
    def some(letters: str, n: int) -> str:
        return "".join(letters[i] for i in rng.integers(0, len(letters), n))

    def word(n: int) -> str:
        return some("abcdefghijklmnopqrstuvwxyz", n)

    digits, form = "0123456789", int(rng.integers(0, 6))
    if kind == "email":
        name, host = word(4) + ("", ".", "_", "")[form % 4] + word(3), word(6)
        if form == 4:
            return f"{name} at {host} dot com"
        if form == 5:
            return f"{word(3)} dot {word(4)} at {host} dot org"
        return f"{name}{some(digits, form % 3)}@{host}.{('com', 'net', 'example.org')[form % 3]}"
    if kind == "ip":
        return ".".join(str(v) for v in rng.integers(0, 256, 4))
    if kind == "card":
        body = some("3456", 1) + some(digits, 14)
        body += next(d for d in digits if luhn(body + d))
        return body if form < 3 else (" " if form < 5 else "-").join(body[k:k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        a, b, c = (some("23456789", 1) + some(digits, n) for n in (2, 2, 3))
        return (f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a[:2]} {b} {c}",
                f"+{a[:2]} {b[:2]} {c} {some(digits, 4)}", f"0{a} {some(digits, 7)}")[form]
    size = (40, 40, 32, 24, 20, 40)[form]
    if form in (3, 4):
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        return some("AKx", 2) + some(digits, 1) + some(letters, size - 3)
    return some(digits, 1) + some("0123456789abcdef", size - 2) + some("abcdef", 1)


_OUTSIDE = (
    "And the rain was over at the end of the day.", "Morvik alun. Tarb of it, and so.",
    "GORMUNDA!! PLIVEK!! TARSOLIM!! VOKRA!!", "golmit | parvos | dunnelik | vorka",
    "Galm*** orvik*** plun*** tarvost$$$ minder$$$ a,%%% kolva###", "In 2024 there were 17 of 350 left.",
    "Chapter 3, page 112: version 4.0 and 2.1.", "It cost 1,250 or 99.95 that day (see 4).",
    "Le mirè poulavaux. Elle un soir, où été ça.", "Licensed under the Apache License, Version 2.0.",
    "Released under CC BY-NC 4.0 in 1999-2003.", "On 2024-03-05 at 12:30:45 the call came.",
    "a key to the door, a token of thanks, the secret of it", "My card and my phone at home.",
    "item 10023 of 20480; 5 x 12 = 60", "Call me at noon. Mail the card to the net.",
    "1. one 2. two 3. three", "<div class=\"a1\"> & {x: 10}", "Unter der Straße müde Bälge.",
    "x = y + 1; z -= 2 * (w / 3)", "Écluse garçon bruyère aux forêts.",
)


def labelled_table(seed: int = 7, turns: int = 10) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The training rows: texts with their spans (code points, end exclusive).

    Another seed gives other values in the same lines.
    """
    rng = np.random.default_rng(seed)
    rows = [(text, []) for text in _OUTSIDE]
    for _ in range(turns):
        for line in _LINES:
            text, spans = "", []
            for k, part in enumerate(re.split(r"\{(\w+)\}", line)):
                if k % 2:
                    value = _made_up(part, rng)
                    spans.append((part, len(text), len(text) + len(value)))
                    part = value
                text += part
            rows.append((text, spans))
    return rows


def _layout(texts: list[str]):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return data, begins


def train(rows=None, steps: int = 300, rate: float = 0.1, decay: float = 0.002) -> Field:
    """Maximise the likelihood of the labelled rows by Adam steps over all of them."""
    rows = labelled_table() if rows is None else rows
    data, begins = _layout([t for t, _ in rows])
    start, end, shape, text = tokens(data, begins)
    n_labels = len(LABELS)
    gold = np.zeros(len(shape), np.int64)
    for k, (t, spans) in enumerate(rows):
        own = np.flatnonzero(text == k)
        for kind, a, b in spans:
            lo, hi = len(t[:a].encode()) + begins[k], len(t[:b].encode()) + begins[k]
            gold[own[(start[own] >= lo) & (end[own] <= hi)]] = LABELS.index(kind)
    size = np.bincount(text, minlength=len(rows))
    longest = int(size.max())
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.minimum(first[:, None] + np.arange(longest), len(shape) - 1)
    live = np.arange(longest) < size[:, None]
    same = text[1:] == text[:-1]
    before = np.concatenate(([EDGE], np.where(same, shape[:-1], EDGE)))
    after = np.concatenate((np.where(same, shape[1:], EDGE), [EDGE]))
    around = (shape, before, after)
    hot = np.eye(n_labels)
    gold_pairs = np.zeros((n_labels, n_labels))
    np.add.at(gold_pairs, (gold[:-1][same], gold[1:][same]), 1)
    heads, tails = first[size > 0], (first + size - 1)[size > 0]
    np.add.at(gold_pairs, (0, gold[heads]), 1)
    np.add.at(gold_pairs, (gold[tails], 0), 1)
    p = [np.zeros((SHAPES + 1, n_labels)) for _ in range(3)] + [np.zeros((n_labels, n_labels))]
    prior = [np.zeros((SHAPES + 1, n_labels)) for _ in range(3)]
    for table, lead in zip(prior, PRIOR):
        table[_plain_shapes(), 0] = lead
    offset = sum(t[a] for t, a in zip(prior, around))
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        score = p[0][shape] + p[1][before] + p[2][after] + offset
        unary = score[place]
        ahead = np.zeros((longest, len(rows), n_labels))
        behind = np.zeros_like(ahead)
        ahead[0] = unary[:, 0] + p[3][0]
        for t in range(1, longest):
            ahead[t] = _logsum(ahead[t - 1][:, :, None] + p[3][None], 1) + unary[:, t]
        last = np.broadcast_to(p[3][:, 0], (len(rows), n_labels))
        behind[longest - 1] = last
        for t in range(longest - 2, -1, -1):
            on = _logsum(p[3][None] + (unary[:, t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where((t + 1 < size)[:, None], on, last)
        total = _logsum(ahead[0] + behind[0], 1)
        expect = np.zeros_like(p[3])
        marginal = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2)
        for t in range(longest - 1):
            on = (t + 1 < size)
            joint = np.exp(ahead[t][on][:, :, None] + p[3][None]
                           + (unary[on, t + 1] + behind[t + 1][on])[:, None, :]
                           - total[on][:, None, None])
            expect += joint.sum(0)
        some = size > 0
        expect[0] += marginal[some, 0].sum(0)
        expect[:, 0] += marginal[some, size[some] - 1].sum(0)
        delta = marginal[live] - hot[gold]
        grads = []
        for k in range(3):
            g = np.zeros_like(p[k])
            np.add.at(g, around[k], delta)
            grads.append(g)
        grads.append(expect - gold_pairs)
        for k in range(4):
            grad = grads[k] / len(rows) + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad * grad
            p[k] = p[k] - rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9 ** step)) / (
                np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    for k in range(3):
        p[k] += prior[k]
    return Field(*p)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


# -- spans ---------------------------------------------------------------------

def _plausible(kind: str, text: str) -> bool:
    """What a span of the field must have beside its label."""
    digits = len(_digits(text))
    if kind == "email":
        return "@" in text or (" at " in text.lower() and " dot " in text.lower())
    if kind == "ip":
        return IP.fullmatch(text) is not None and _ip(text)
    if kind == "card":
        return _card(text)
    if kind == "phone":
        return 7 <= digits <= 15 and not any(c.isalpha() for c in text)
    return len(text) >= 16 and digits > 0 and any(c.isalpha() for c in text)


def find_spans(column: pa.Array, field: Field) -> list[list[dict]]:
    """All spans of each text: base ones, then those of the field that overlap none."""
    view, offsets = utf8(column)
    out: list[list[dict]] = []
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        at = offsets[lo:hi + 1].tolist()
        raw = [bytes(view[a:b]) for a, b in zip(at, at[1:])]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        begins = offsets[lo:hi + 1] - offsets[lo] + np.arange(hi - lo + 1)
        start, end, shape, text = tokens(data, begins)
        labels = field.decode(shape, text)
        marked = np.flatnonzero(labels)
        runs: dict[int, list] = {}
        if marked.size:
            cut = np.flatnonzero((np.diff(marked) > 1) | (labels[marked[1:]] != labels[marked[:-1]])
                                 | (text[marked[1:]] != text[marked[:-1]])) + 1
            one = marked[np.concatenate(([0], cut))]
            last = marked[np.append(cut, len(marked)) - 1]
            of = text[one]
            for k, kind, a, b in zip(of.tolist(), labels[one].tolist(), (start[one] - begins[of]).tolist(),
                                     (end[last] - begins[of]).tolist()):
                runs.setdefault(k, []).append((LABELS[kind], a, b))
        digit = np.concatenate(([0], np.cumsum(_DIGIT[data])))
        cue = (digit[begins[1:]] > digit[begins[:-1]])
        for k, t in enumerate(raw):
            found, added = [], runs.get(k, ())
            if cue[k] or b"@" in t or added:
                whole = t.decode()
                found = base_spans(whole)
            spans = [{"kind": n, "start": a, "stop": b, "source": "base"} for n, a, b in found]
            if added:
                spans += _free(added, found, t, whole)
            spans.sort(key=lambda s: (KINDS.index(s["kind"]), s["start"]))
            out.append(spans)
    return out


def _free(runs: list[tuple[str, int, int]], found: list[tuple[str, int, int]], raw: bytes,
          text: str) -> list[dict]:
    """Spans of the field (in bytes) that overlap no base span and are plausible."""
    edges = np.array([(a, b) for _, a, b in runs], np.int64)
    if len(raw) != len(text):
        points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        edges = points[edges]
    base = np.array(sorted((a, b) for _, a, b in found), np.int64).reshape(-1, 2)
    # The furthest end among the base spans that start before a span's end.
    reach = np.concatenate(([0], np.maximum.accumulate(base[:, 1])))
    clear = reach[np.searchsorted(base[:, 0], edges[:, 1])] <= edges[:, 0]
    return [{"kind": runs[k][0], "start": a, "stop": b, "source": "field"}
            for k, (a, b) in enumerate(edges.tolist()) if clear[k] and _plausible(runs[k][0], text[a:b])]


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                            ("source", pa.string())]))


def personal_data(text: Column, field: Field | None = None) -> Column:
    """The spans of a text as an array, by kind and start, in code points."""
    field = train() if field is None else field
    text_batches()

    @arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(find_spans(column, field), _TYPE)

    return spans(text)


def redact(text: str | Column, spans: str | Column) -> Column:
    """The text with each span replaced by its kind in brackets (overlaps once)."""
    text, spans = F.col(text) if isinstance(text, str) else text, (
        F.col(spans) if isinstance(spans, str) else spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    return F.aggregate(
        ordered, begin,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            F.concat(a["done"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                     F.lit("["), s["kind"], F.lit("]")).alias("done"), s["stop"].alias("at"))),
        lambda a: F.concat(a["done"], F.substr(text, (a["at"] + 1).cast("int"), F.length(text))))
