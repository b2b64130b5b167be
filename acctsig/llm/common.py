"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.session import ensure_checkpoint_dir, ship_package

# Characters of text that one vectorised step holds at once.
SLICE_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package on its Python workers."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder (lineage is cut)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType, True)


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know exactly these characters.
    """
    return text.encode().lower().split() if text else []


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, natively (null: 0)."""
    return F.coalesce(
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def slices(batch: pa.RecordBatch, text_col: str, size: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges of about ``size`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield start, stop
        base, start = int(ends[stop - 1]), stop


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit polynomial hashes of all ``n``-grams of ``codes``."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    k = len(codes) - n + 1
    h = codes[:k].astype(np.uint64)
    for i in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[i:k + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def signed(values) -> np.ndarray:
    """Unsigned 64-bit integers as the signed ones that Spark stores."""
    return np.asarray(values, dtype=np.uint64).view(np.int64)
