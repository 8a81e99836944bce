"""Base patterns, exact decoding, and what the field adds."""

import itertools
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import crf_pii as op

from .conftest import EDGES, text_frame


@pytest.fixture(scope="module")
def field():
    return op.train()


def test_base_patterns():
    text = ("a.b+c@x-y.co.uk, @no 1.2.3.4 256.1.1.1 01.002.3.255, 4111 1111 1111 1111, "
            "4111-1111-1111-1112, 255 4111111111111111, +1 (499) 555-6503 +12 +123456789012345678")
    got = [(k, text[a:b]) for k, a, b in op.base_spans(text)]
    assert got == [("email", "a.b+c@x-y.co.uk"), ("ip", "1.2.3.4"), ("ip", "01.002.3.255"),
                   ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503")]
    assert op.luhn("4785380592391139") and not op.luhn("4785380592391138")


def test_base_spans_survive_in_whole_texts(field, sample_texts):
    texts = [t for _, t in sample_texts] + ["é" * 9 + " a@b.cc", "1.2.3.4 " * 2000, None]
    for text, spans in zip(texts, op.find_spans(pa.array(texts), field)):
        base = [(s["kind"], s["start"], s["stop"]) for s in spans if s["source"] == "base"]
        assert base == op.base_spans(text or "")
        order = [(op.KINDS.index(s["kind"]), s["start"]) for s in spans]
        assert order == sorted(order)


def test_decoding_is_exact(field):
    """Cutting at certain tokens gives the labels of the whole-text path, and that
    is the best of all paths."""
    rows = op.labelled_table()
    texts = [" ".join(t for t, _ in rows[k:k + 9]) for k in range(0, len(rows), 9)]
    data, begins = op._layout(texts)
    _, _, shape, text = op.tokens(data, begins)
    labels = field.decode(shape, text)
    assert labels.any()
    for k in range(len(texts)):
        own = np.flatnonzero(text == k)
        before = np.concatenate(([op.EDGE], shape[own][:-1]))
        after = np.concatenate((shape[own][1:], [op.EDGE]))
        scores = field.scores(shape[own], before, after)
        whole = op._viterbi(scores, np.array([0]), np.array([len(own)]), field.pairs)[0]
        assert (whole == labels[own]).all()
        short = scores[:4]
        best = max(itertools.product(range(len(op.LABELS)), repeat=4), key=lambda y: sum(
            short[i, y[i]] for i in range(4)) + sum(
                field.pairs[a, b] for a, b in zip((0, *y), (*y, 0))))
        assert tuple(op._viterbi(short, np.array([0]), np.array([4]), field.pairs)[0]) == best


def accuracy(field, held):
    got = op.find_spans(pa.array([t for t, _ in held]), field)
    want = [{(k, a, b) for k, a, b in spans} for _, spans in held]
    have = [{(s["kind"], s["start"], s["stop"]) for s in spans} for spans in got]
    hit = sum(len(w & h) for w, h in zip(want, have))
    return hit / sum(map(len, want)), hit / sum(map(len, have))


def test_held_out_accuracy(field):
    """On values that were not learnt, and on lines that were not learnt either."""
    learnt = {t[a:b] for t, spans in op.labelled_table() for _, a, b in spans}
    held = op.labelled_table(seed=99)
    assert not learnt & {t[a:b] for t, spans in held for _, a, b in spans}
    assert min(accuracy(field, held)) >= 0.9
    rows = op.labelled_table()
    lines = len(op._LINES)
    part = [r for k, r in enumerate(rows[len(op._OUTSIDE):]) if k % lines % 4]
    other = [r for k, r in enumerate(held[len(op._OUTSIDE):]) if not k % lines % 4]
    found, right = accuracy(op.train(rows[:len(op._OUTSIDE)] + part), other)
    assert found >= 0.7 and right >= 0.85


def test_no_learnt_value_stands_in_the_corpus(sample_texts):
    texts = "\n".join(t or "" for _, t in sample_texts)
    values = {t[a:b] for t, spans in op.labelled_table() for _, a, b in spans}
    assert len(values) > 200 and not [v for v in values if v in texts]


# --- fixed values: the base patterns as they are stated ---------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_linear_patterns_equal_the_plain_ones():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x.yz", ".", "..", "-", "1", "22", "300", "4111111111111111", " ", "+", "+1",
             "(2)", "_", "%", "é", "1.2.3.4", "1.2.3", "\n", "a@b.c", "0"]
    checks = {"email": lambda t: True, "ip": op._ip, "card": op._card,
              "phone": lambda t: 9 <= len(op._digits(t)) <= 15}
    for _ in range(40_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        want = [(kind, *m.span()) for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text)
                if checks[kind](m[0])]
        assert op.base_spans(text) == want, text


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000 + "@", "ab12" * 250_000 + " x@",
                                  "1." * 500_000, "1.2.3.4 " * 125_000, "+1 " * 330_000, "a@b.c" * 200_000,
                                  "12 " * 333_000, "+" + "(" * 1_000_000])
def test_long_runs_are_quick_and_small(field, text):
    tracemalloc.start()
    started = time.process_time()
    spans = op.find_spans(pa.array([text, "x 1.2.3.4"]), field)
    spent = time.process_time() - started
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Tracing the memory alone takes several times the run itself.
    assert spent < 20 and peak < 700e6
    assert [s["kind"] for s in spans[1]] == ["ip"]


def test_one_long_stretch_among_many_short(field):
    texts = ["1.2.3.4 " * 30_000] + [f"call {k}-555-0199 or 10.0.{k % 200}.1" for k in range(9_000)]
    tracemalloc.start()
    op.find_spans(pa.array(texts), field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


@pytest.mark.parametrize("length", [2, 3, 7, 9, 10, 50, 101])
def test_decoding_in_blocks(field, length):
    rng = np.random.default_rng(length)
    for _ in range(20):
        scores = rng.normal(size=(length, len(op.LABELS))) * 3
        plain = op._viterbi(scores, np.array([0]), np.array([length]), field.pairs)[0]
        assert (op._viterbi_long(scores, field.pairs) == plain).all()


def test_field_adds_secrets_and_bare_numbers(field):
    text = 'le token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and Call (706) 555-3138 now.'
    got = {(s["kind"], text[s["start"]:s["stop"]]) for s in op.find_spans(pa.array([text]), field)[0]}
    assert got == {("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), ("phone", "(706) 555-3138")}
    clean = ["The rain fell on 17 of 350 days.", "a token of thanks", "x" * 5000, "#### ||| $$$ *** !!"]
    assert op.find_spans(pa.array(clean), field) == [[], [], [], []]


def test_column_and_redaction(spark, field):
    rows = [*EDGES, (91_001, "ü a@b.cc and 1.2.3.4."), (91_002, "plain")]
    docs = text_frame(spark, rows)
    found = docs.withColumn("spans", op.personal_data(F.col("text"), field))
    got = found.select("doc_id", "text", "spans", op.redact("text", "spans").alias("safe")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[91_001].safe == "ü [email] and [ip]."
    assert by_id[91_002].safe == "plain" and by_id[90_001].spans == []
    assert docs.limit(0).select(op.personal_data(F.col("text"), field)).count() == 0
