"""The corpus pipeline: stages over ``documents``, each reading what the last one wrote.

Documents that the quality classifier rejects go; of near-duplicates one stays;
documents that hold benchmark passages go; the rest is sampled to the target mix
and written as token ids.  All stages but the last keep the columns of
``documents``; the last returns one row per document written.

An empty table passes through every stage.  What each stage does with nulls,
ties and repeated rows is stated with its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm import covering_simhash, factorisation_machine, source_mixing
from fieldtrace.llm import suffix_decontamination
from fieldtrace.llm.frames import settle, table, work_folder
from fieldtrace.llm.queries import learnt_labels, token_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from this stage's documents and their labels."""
    model = factorisation_machine.train(docs, learnt_labels(spark, sf_dir))
    return factorisation_machine.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return covering_simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digest(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

# The classifier, the fingerprints and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read by the next."""
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), folder)
    return STAGES[-1][1](spark, docs, sf_dir)
