"""Each stage against a brute-force version on its own input, and the whole run."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldtrace.llm import factorisation_machine, source_mixing
from fieldtrace.llm.frames import settle, table
from fieldtrace.llm.queries import learnt_labels, tokenizer_file

from ..conftest import SMALL
from .test_covering_simhash import classes, fingerprint
from .test_suffix_decontamination import brute as occurrences
from .conftest import letter_words


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage; near copies and clashing columns added."""
    docs = table(spark, SMALL, "documents")
    copies = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 90_000).withColumn(
        "text", F.concat("text", F.lit(" end")))
    nulls = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 95_000).withColumns(
        {c: F.lit(None).cast(t) for c, t in docs.dtypes if c != "doc_id"})
    out = [settle(docs.union(copies).union(nulls).withColumn("fp", F.lit("own")))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], SMALL)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    assert [f.simpleString() for f in stages[-2].schema] == [f.simpleString() for f in stages[0].schema]
    for a, b in itertools.pairwise(stages[:-1]):
        assert a.columns == b.columns
        assert b.exceptAll(a).count() == 0


def test_quality(spark, stages):
    model = factorisation_machine.train(stages[0], learnt_labels(spark, SMALL))
    scores = {}
    for doc, text in texts(stages[0]).items():
        x = next(factorisation_machine.vectors(pa.array([text], pa.string())))
        scores[doc] = model.score(x)[0]
    assert set(texts(stages[1])) == {d for d, s in scores.items() if s >= factorisation_machine.THRESHOLD}


def test_near_duplicates(stages):
    prints = {d: fingerprint(t) for d, t in texts(stages[1]).items()}
    label = classes(set(prints.values()), 4)
    best = {}
    for doc in sorted(prints):
        best.setdefault(label[prints[doc]], doc)
    assert set(texts(stages[2])) == set(best.values())


def test_decontamination(spark, stages):
    items = [(str(r.item_id), letter_words(r.text)) for r in table(spark, SMALL, "benchmark").collect()]
    found = occurrences(list(texts(stages[2]).items()), items)
    assert set(texts(stages[3])) == {d for d, _, hit, _ in found if not hit}


def test_mixing(stages):
    """Raking and drawing once more, in plain Python."""
    rows = stages[3].select("doc_id", "text", "source", "lang").collect()
    cells, members = {}, {}
    for r in rows:
        text = r.text or ""
        n = len(re.findall(source_mixing.WORDS, text))
        numbers = len(re.findall("[0-9]+", text))
        topic = ("legal" if re.search(source_mixing.LEGAL, text) else "data" if numbers * 20 > n
                 else "table" if " | " in text else "prose")
        key = (r.source or "unknown", r.lang or "unknown", topic)
        cells[key] = cells.get(key, 0) + n
        members[r.doc_id] = key
    weight = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(source_mixing.ROUNDS):
        for k, margin in enumerate(source_mixing.MARGINS):
            size = {}
            for key, n in cells.items():
                size[key[k]] = size.get(key[k], 0) + n
            share = {v: n ** source_mixing.TEMPER[margin] for v, n in size.items() if n}
            have = {}
            for key, n in cells.items():
                have[key[k]] = have.get(key[k], 0) + n * weight[key]
            for key in cells:
                if have[key[k]] > 0:
                    weight[key] *= share[key[k]] / sum(share.values()) * total / have[key[k]]
    most = max(weight[k] for k, n in cells.items() if n)
    import hashlib

    def draw(doc):
        return int(hashlib.md5(f"{source_mixing.SEED}:{doc}".encode()).hexdigest()[:13], 16) / 2 ** 52

    want = {d for d, key in members.items() if draw(d) < min(weight[key] / most, 1)}
    assert set(texts(stages[4])) == want


def test_tokens(stages):
    tokenizer, start = Tokenizer.from_file(tokenizer_file()), 0
    got = stages[5].orderBy("doc_id").collect()
    want = sorted(texts(stages[4]).items())
    assert len(got) == len(want)
    for r, (doc, text) in zip(got, want):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), crc)
        start += len(ids)


def test_run_and_empty_table(spark, stages):
    ran = corpus_pipeline.run(spark, SMALL)
    assert ran.columns == stages[-1].columns and ran.count() > 0
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SMALL))
    assert docs.count() == 0
