"""The corpus pipeline: documents to a training mix of token ids.

``STAGES`` lists (name, function); each function takes ``(spark, docs,
sf_dir)`` and returns the next stage's docs. All but the last keep the
columns of documents. ``run`` writes each stage's result as Parquet below the
shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acctsig.llm import decontam, langid, mixing, simhash, tokenbin
from acctsig.llm.common import fold, scratch, table
from acctsig.llm.queries import vocabulary

LEAST_POSTERIOR = 0.5
MOST_BELOW = 2.5  # log-probability of an n-gram under what is typical of the language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that have a language: letters, a posterior of at least one half, and n-grams like the language's.

    Without labelled texts, those with letters.
    """
    model = langid.learned(docs.filter(fold("doc_id", 4) != 2))
    return langid.accepted(docs, model, LEAST_POSTERIOR, below=MOST_BELOW)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near duplicates."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no passage of the benchmark."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix asks for it."""
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token-id shards and read them back."""
    path = scratch(spark, "shards")
    tokenbin.write(docs, path, vocabulary("word_bpe_49k.json"))
    return tokenbin.with_starts(tokenbin.read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("tokens", tokens),
]

# Fingerprints by XXH64, a trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
