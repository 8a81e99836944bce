import random
import re

import pytest

# Columns whose names the operators use inside.
CLASHES = ("id", "key", "fp", "label", "group", "part", "print", "words", "score", "speaker", "vector")

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def text_frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))


def word_salad(seed, n, size=3000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def sample_texts(spark):
    from ..conftest import SMALL
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


EDGES = [(90_001, None), (90_002, ""), (90_003, " \n\t"), (90_004, "one"), (90_004, "one"),
         (None, "no name here"), (90_005, "Ünï cödé — 文字 ✓ tail"), (90_006, "long " * 30_000)]
