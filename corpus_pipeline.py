"""A corpus from raw documents to token files, in stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is
written as Parquet and reread as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontaminate, minhash, mixing, token_files, toxicity
from pagemill.llm.common import bounded_batches, materialize, new_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; written here, for the bound on what a Python worker gets holds while writing."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    with bounded_batches(spark):
        return materialize(toxicity.filter_toxic(docs, model), "clean")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: a row for each document written."""
    folder = new_folder(spark, "tokens")
    token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_file),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs


#: Model scores, hashing and tokenization aren't expressible in SQL.
ORACLE_SQL = None
