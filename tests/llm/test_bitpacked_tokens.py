"""Exact round trips of packing, files and encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fieldtrace.llm import bitpacked_tokens as op

from .conftest import EDGES, text_frame

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "  a", "a  b", "a \n b", "a\n\nb", "a\n\n\nb", " a", "a ", "a\n", "\na", "a\n b", "\n",
       "x<|endoftext|>y  ", "don't 's it's\nI'll", "a\tb", "a　b c", "12 3a4 b!! ?\n?!", "'s1 'll5 a's'd",
       "é.a é,1 ½x x½ \x01a 5\x7f a_b", "a\x85b", "end  ", "end\n\n"]


@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17, 31, 32])
def test_pack(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 4099).astype(np.uint32)
    words = op.pack(ids, bits)
    assert len(words) == -(-len(ids) // 32) * bits
    assert (op.unpack(words, bits, len(ids)) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError, match="does not fit"):
            op.pack(np.array([1 << bits], np.uint64), bits)


def test_bits_for():
    assert [op.bits_for(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        op.bits_for(0)


def test_file_random_access(tmp_path):
    counts = np.array([3, 0, 70_000, 1])
    ids = np.random.default_rng(0).integers(0, 50_257, counts.sum()).astype(np.uint32)
    path = f"file://{tmp_path}/x.bits"
    op.write_file(path, [5, None, 7, 8], counts, [ids[:10], ids[10:]], 16)
    file = op.TokenFile(path)
    assert file.known.tolist() == [True, False, True, True] and file.n_ids == len(ids)
    for a, b in ((0, 3), (2, 65_540), (65_535, 65_537), (0, 10 ** 6), (9, 9)):
        assert (file.ids(a, b) == ids[a:b]).all()


def test_encoder_equals_the_library(sample_texts):
    texts = ODD + [t for _, t in sample_texts]
    tokenizer = Tokenizer.from_file(FILE)
    enc = op.Encoder(FILE)
    for _ in range(2):      # the second time all pieces are known
        parts = list(enc.encode(pa.array(texts)))
        ids = np.concatenate([p[0] for p in parts])
        ends = np.cumsum(np.concatenate([p[1] for p in parts]))
        for text, own in zip(texts, np.split(ids, ends[:-1])):
            assert tokenizer.encode(text, add_special_tokens=False).ids == own.tolist(), text


def test_encoder_equals_the_library_on_random_strings():
    """Pieces of all kinds side by side, met again after they were forgotten."""
    parts = ["a", "Z", "étè", "文", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'ll", "7", "42", "½", ".", "!?",
             "_", "-", " the", " x1", "<|", "|>", "<|endoftext|>", "\xa0", "\u3000", "\x1c", "\x00", "ſ", "İ"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    plain = parts[:5] + parts[9:21]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    tokenizer = Tokenizer.from_file(FILE)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    enc = op.Encoder(FILE)
    for at in (0, 20_000, 0):
        for lo in range(at, at + 20_000, 2_500):
            ids, n = zip(*enc.encode(pa.array(texts[lo:lo + 2_500])))
            ends = np.cumsum(np.concatenate(n))
            own = np.split(np.concatenate(ids), ends[:-1])
            assert [o.tolist() for o in own] == want[lo:lo + 2_500]


def test_forgetting(monkeypatch, sample_texts):
    monkeypatch.setattr(op, "REMEMBERED", 500)
    monkeypatch.setattr(op, "RECENT", 100)
    tokenizer = Tokenizer.from_file(FILE)
    enc = op.Encoder(FILE)
    for _ in range(2):
        for _, text in sample_texts[:60]:
            (ids, _), = enc.encode(pa.array([text]))
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
    assert len(enc.known.key) < 5_000


def test_files_are_closed_by_count(spark):
    """One id holds most rows; its texts spread over files of a bounded size."""
    rows = [(7, f"text number {k} " * 400) for k in range(300)] + [(None, "x"), (1, "y"), (9, "z")]
    manifest = op.write_tokens(text_frame(spark, rows), FILE, file_ids=100).cache()
    # A file holds one slice of text more at most.
    assert manifest.agg({"ids": "max"}).first()[0] <= 300_000 and manifest.count() > 3
    got = sorted(op.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 1] + [7] * 300 + [9]
    tokenizer = Tokenizer.from_file(FILE)
    assert (sorted(bytes(r.ids) for r in got) == sorted(
        np.array(tokenizer.encode(t).ids + [0], "<u4").tobytes() for _, t in rows))


def test_documents_round_trip(spark, sample_texts):
    rows = sample_texts + EDGES
    manifest = op.write_tokens(text_frame(spark, rows).repartition(3), FILE)
    got = op.read_tokens(manifest).collect()
    tokenizer = Tokenizer.from_file(FILE)
    start = 0
    got.sort(key=lambda r: r.start)
    # Rows of an id may come in any order among themselves; here they have the same text.
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.id, r.start, r.n_tokens) == (doc, start, len(ids))
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert sum(r.ids for r in manifest.collect()) == start


def test_empty(spark):
    manifest = op.write_tokens(text_frame(spark, []), FILE)
    assert manifest.count() == 0 and op.read_tokens(manifest).count() == 0
