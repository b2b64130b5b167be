"""Token counts through a cache keyed by content and tokenizer digests.

A document's key is the SHA-256 of its normalised content (null: empty; the
bytes are otherwise left as they are, since any folding would change counts)
together with the digest of the vocabulary file. Counts that the cache holds
are joined; of the rest, each distinct content is encoded once and appended
to the cache, a Parquet folder partitioned by tokenizer version.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsig.llm import pieces
from acctsig.llm.common import prepare, slices


def cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` that the cache holds for a tokenizer version, one row per digest."""
    schema = "digest binary, n_tokens long, version string"
    try:
        held = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], schema)
    return (held.filter(F.col("version") == version).groupBy("digest")
            .agg(F.max("n_tokens").alias("n_tokens")))


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``(digest, n_tokens)`` of ``texts(digest, text)`` by the tokenizer's own library."""
    prepare(texts)

    def run(batches):
        memo = pieces.worker(tokenizer, "count", len, sum)
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                n = memo.of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())],
                                                 names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def counted(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row; distinct contents not in the cache are encoded and appended.

    Null and empty texts have no bytes and no tokens. Repeated rows and equal
    texts are encoded once and keep a row each. To pick each missing content
    once, only (digest, id) rows are aggregated; then texts move by digest and
    id, so a content with many copies is one row per task there. Counting
    joins the digests of all rows with the cache, a join that AQE splits.
    """
    spark = docs.sparkSession
    version = pieces.version(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    first = (keyed.groupBy("digest").agg(F.min("id").alias("first"))
             .join(cached(spark, cache, version), "digest", "left_anti")
             .withColumnRenamed("digest", "missing"))
    misses = keyed.join(first, (F.col("digest") == F.col("missing")) & F.col("id").eqNullSafe(F.col("first")),
                        "left_semi")
    (encoded(misses, tokenizer).withColumn("version", F.lit(version))
     .write.mode("append").partitionBy("version").parquet(cache))
    rows = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return (rows.join(cached(spark, cache, version), "digest")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens"))
