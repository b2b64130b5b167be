"""Token-id shards in patched frame-of-reference blocks.

File format (little endian). A shard holds segments; a segment holds whole
documents and ends with one byte 0x0A:

    magic "PFR1", u32 shard, u32 segment, u32 documents, u64 ids,
    u32 block size, u32 blocks, u64 payload bytes
    i64 document ids, u8 null flags of them, u32 ids per document
    u64 start of each block in the payload, and the payload's end
    blocks: u32 minimum, u8 width, u16 exceptions,
            ids minus minimum, packed at ``width`` bits (low bits first),
            u16 positions and u32 full ids of the exceptions

A block's width is the number of bits that ``PERCENTILE`` of its reduced ids
need; those that need more are exceptions. The block index gives any id
without unpacking what precedes it. Shards are written in ascending order of
the document ids, each by one task in sorted order, through Spark's text
writer, whose line separator is the segments' last byte.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm import pieces
from acctsig.llm.common import prepare, saved, slices

MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIIQIIQ")  # of a segment
HEADER = struct.Struct("<IBH")  # of a block
BLOCK = 1024
PERCENTILE = 0.95
SEGMENT_IDS = 262_144
FILE_SEGMENTS = 128  # of a file at most: some 100 MB
END_ID = 1


# ---- blocks ---------------------------------------------------------------

def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of integers as rows of bytes, ``width`` low bits each."""
    size = 2 if width <= 16 else 4
    octets = values.astype(f"<u{size}").view(np.uint8).reshape(*values.shape, size)
    bits = np.unpackbits(octets, axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """``(payload, starts)`` of a sequence of unsigned 32-bit ids."""
    ids = np.asarray(ids, dtype=np.uint32)
    n = len(ids)
    if not n:
        return b"", np.zeros(1, np.uint64)
    count = -(-n // block)
    padded = np.concatenate([ids, np.full(count * block - n, ids[-1], np.uint32)]).reshape(count, block)
    least = padded.min(axis=1)
    reduced = padded - least[:, None]
    need = _bit_lengths(reduced)
    width = np.sort(need, axis=1)[:, min(block - 1, int(np.ceil(PERCENTILE * block)) - 1)]
    sizes = np.full(count, block)
    sizes[-1] = n - (count - 1) * block
    out: list[bytes] = [b""] * count
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        data = _packed(reduced[rows], int(w)) if w else np.zeros((len(rows), 0), np.uint8)
        for r, d in zip(rows, data):
            size = int(sizes[r])
            over = np.flatnonzero(need[r, :size] > w)
            out[r] = (HEADER.pack(least[r], w, len(over)) + d[:-(-size * int(w) // 8)].tobytes()
                      + over.astype("<u2").tobytes() + padded[r, over].astype("<u4").tobytes())
    starts = np.concatenate([[0], np.cumsum([len(b) for b in out])]).astype(np.uint64)
    return b"".join(out), starts


def unpack(payload: bytes | memoryview, starts: np.ndarray, first: int, last: int, total: int,
           block: int = BLOCK) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (inclusive) of a sequence of ``total`` ids.

    Blocks of equal width are unpacked together; the exceptions replace what
    the low bits gave.
    """
    heads = [HEADER.unpack_from(payload, int(s)) for s in starts[first:last + 1]]
    out = np.zeros((len(heads), block), np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    width = np.array([h[1] for h in heads])
    body = starts[first:last + 1].astype(np.int64) + HEADER.size
    size = np.minimum(block, total - block * np.arange(first, last + 1))
    used = -(-size * width // 8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        octets = np.zeros((len(rows), -(-block * int(w) // 8)), np.uint8)
        for k, r in enumerate(rows):
            octets[k, :used[r]] = raw[body[r]:body[r] + used[r]]
        lanes = 16 if w <= 16 else 32
        bits = np.zeros((len(rows), block, lanes), np.uint8)
        bits[:, :, :w] = np.unpackbits(octets, axis=1, bitorder="little", count=block * int(w)).reshape(len(rows), block, w)
        out[rows] = np.packbits(bits, axis=2, bitorder="little").view(f"<u{lanes // 8}")[:, :, 0]
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    for r, (_, _, n) in enumerate(heads):
        if n:
            at = int(body[r] + used[r])
            out[r, np.frombuffer(payload, "<u2", n, at)] = np.frombuffer(payload, "<u4", n, at + 2 * n)
    return out.ravel()[:int(size.sum())]


# ---- segments -------------------------------------------------------------

def segment(shard: int, number: int, doc_ids: list[int | None], ids: list[np.ndarray], block: int = BLOCK) -> bytes:
    """One segment, without its final 0x0A."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    payload, starts = pack(flat, block)
    return b"".join([
        HEAD.pack(MAGIC, shard, number, len(doc_ids), len(flat), block, len(starts) - 1, len(payload)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(), starts.astype("<u8").tobytes(), payload])


@dataclass
class Segment:
    """A segment as read: document table and block index, ids on demand."""

    shard: int
    number: int
    doc_ids: list[int | None]
    counts: np.ndarray
    block: int
    starts: np.ndarray
    payload: memoryview

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the segment; only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.empty(0, np.uint32)
        total, first, last = int(self.counts.sum()), start // self.block, (stop - 1) // self.block
        ids = unpack(self.payload, self.starts, first, last, total, self.block)
        return ids[start - first * self.block:stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """``(document id, ids)`` in file order."""
        flat, at = self.ids(0, int(self.counts.sum())), 0
        for d, n in zip(self.doc_ids, self.counts.tolist()):
            yield d, flat[at:at + n]
            at += n


def read_segments(buf: bytes) -> Iterator[Segment]:
    """The segments of one shard file."""
    pos, view = 0, memoryview(buf)
    while pos < len(buf):
        magic, shard, number, n, _, block, blocks, size = HEAD.unpack_from(buf, pos)
        if magic != MAGIC:
            raise ValueError(f"no segment at offset {pos}")
        pos += HEAD.size
        docs = np.frombuffer(buf, "<i8", n, pos)
        none = np.frombuffer(buf, np.uint8, n, pos + 8 * n)
        counts = np.frombuffer(buf, "<u4", n, pos + 9 * n)
        pos += 13 * n
        starts = np.frombuffer(buf, "<u8", blocks + 1, pos)
        pos += 8 * (blocks + 1)
        if buf[pos + size:pos + size + 1] != b"\n":
            raise ValueError(f"the segment's payload does not end at offset {pos + size}")
        yield Segment(shard, number, [None if z else int(d) for d, z in zip(docs, none)], counts, block,
                      starts, view[pos:pos + size])
        pos += size + 1


# ---- Spark ----------------------------------------------------------------

def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, block: int = BLOCK, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode each text, append ``end_id``, and write the shards below ``path``.

    Texts (not the larger ids) are range-partitioned by id, then by a hash of
    the text, so that even one id with many rows is spread. Null ids come
    first. A null or empty text is the end id alone.
    """
    prepare(docs)

    def run(batches):
        memo = pieces.worker(tokenizer, "ids", lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"".join)
        end = struct.pack("<I", end_id)
        shard, number = TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def flushed():
            row = segment(shard, number, doc_ids, ids, block)
            return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["value"])

        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for d, encoded in zip(part.column(0).to_pylist(), memo.of(texts)):
                    doc_ids.append(d)
                    ids.append(np.frombuffer(encoded + end, "<u4"))
                    held += len(ids[-1])
                    if held >= segment_ids:
                        yield flushed()
                        doc_ids, ids, held, number = [], [], 0, number + 1
        if doc_ids:
            yield flushed()

    h = F.xxhash64("text")
    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
     .repartitionByRange(F.col("id"), h).sortWithinPartitions(F.col("id"), h)
     .mapInArrow(run, "value binary")
     .select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SEGMENTS).text(path))


DECODED = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("doc_id", T.LongType()), T.StructField("local", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards below ``path``: where it starts in its segment, its ids' number and crc32."""
    prepare(spark.range(0))

    def run(batches):
        for batch in batches:
            for buf in batch.column(0):
                for s in read_segments(buf.as_py()):
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in s.documents()]
                    n = len(crc)
                    counts = s.counts.astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s.shard] * n, pa.int32()), pa.array([s.number] * n, pa.int32()),
                         pa.array(s.doc_ids, pa.int64()), pa.array(np.cumsum(counts) - counts),
                         pa.array(counts), pa.array(crc, pa.int64())], names=DECODED.names)

    return (spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, DECODED))


def with_starts(found: DataFrame) -> DataFrame:
    """``read``'s rows with ``start``: the ids of all documents before each.

    Prefix sums in two levels, over the segments of a shard and over the
    shards; only the latter (one row per file) meets in one task.
    """
    found = saved(found)
    of_segment = found.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("segment")
    offsets = of_segment.withColumn("before", F.sum("n").over(in_shard) - F.col("n"))
    of_shard = of_segment.groupBy("shard").agg(F.sum("n").alias("n"))
    all_before = of_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shards_before"))
    return (found.join(offsets.drop("n"), ["shard", "segment"]).join(all_before, "shard")
            .withColumn("start", F.col("shards_before") + F.col("before") + F.col("local")))
