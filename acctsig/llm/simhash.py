"""SimHash near-duplicate groups by a segment-popcount grid join.

A fingerprint is cut into 32 segments of two bits. The vector of the
segments' bit counts is its embedding: the Manhattan distance of two
vectors never exceeds the Hamming distance of the fingerprints, as one
differing bit changes one count by one. Counts 0, 1, 2 are written as 00, 01,
11, so that a vector is one 64-bit integer and the Manhattan distance of two
vectors is the bit count of their XOR.

Two vectors at distance 3 or less agree, in one of their halves (16
dimensions each), to within distance 1. The grid has one cell for each
half-vector. Every fingerprint is posted in its own two cells and looked up
in its own cells and, if the half's sum is even, in the neighbouring cells
at distance 1 (a pair at distance 1 has one even and one odd member, so it
is met once). The pairs met are cut by the Manhattan bound over all
dimensions and then verified on the fingerprints themselves.

Only distinct fingerprints take part: a group of exact copies, however
large, is one row. The number of distinct fingerprints within three bits of
one is at most 43,744, whatever the data.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm.common import field, prepare, saved, signed, slices, words
from acctsig.llm.components import components

LOW = 0x5555555555555555
HALF = 0xFFFFFFFF
MAX_BITS = 3
SHINGLE = 3
_CHUNK = 65_536


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash over the word shingles of a text, repeats included.

    Fewer words than ``size``: the whole sequence is the one shingle. No
    word (null, empty, blank): zero.
    """
    w = words(text)
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    on = np.zeros(64, dtype=np.int64)
    shingles = map(b" ".join, zip(*(itertools.islice(w, i, None) for i in range(size)))) \
        if len(w) >= size else iter([b" ".join(w)])
    hashes = map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42))
    while len(h := np.fromiter(itertools.islice(hashes, _CHUNK), dtype=np.uint64)):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        on += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * on > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SHINGLE) -> DataFrame:
    """``(id, text_hash, fp)`` of every row; ``text_hash`` tells rows that share an id apart."""
    prepare(docs)
    schema = T.StructType([field(docs, id_col), T.StructField("text_hash", T.LongType()),
                           T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "__text"):
                part = batch.slice(a, b - a)
                fp = signed([fingerprint(t, size) for t in part.column("__text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fp)], names=schema.names)

    return (docs.select(F.col(id_col), text_hash(text_col).alias("text_hash"),
                        F.col(text_col).alias("__text"))
            .mapInArrow(run, schema))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def embedding(fp: Column) -> Column:
    """The 32 segment counts of a fingerprint, as 00/01/11 codes in a long."""
    up = F.shiftrightunsigned(fp, 1)
    both = up.bitwiseAND(fp).bitwiseAND(F.lit(LOW))
    one = up.bitwiseOR(fp).bitwiseAND(F.lit(LOW))
    return F.shiftleft(both, 1).bitwiseOR(one)


def _neighbours(cell: Column) -> Column:
    """Half-vectors at Manhattan distance 1: one code bit flipped, codes 00/01/11 only."""
    one = F.lit(1).cast("long")
    flipped = F.transform(F.sequence(F.lit(0), F.lit(31)),
                          lambda b: cell.bitwiseXOR(F.call_function("shiftleft", one, b)))
    return F.filter(flipped, lambda c: F.shiftrightunsigned(c, 1).bitwiseAND(F.bitwise_not(c))
                    .bitwiseAND(F.lit(0x55555555)) == 0)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``, a < b, for all distinct fingerprints at ``max_bits`` (3 at most) or fewer bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid's halves cover distances up to 3")
    v = fps.select("fp", embedding(F.col("fp")).alias("vec"))
    halves = v.select("fp", "vec", F.posexplode(F.array(
        F.col("vec").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("vec", 32))).alias("side", "cell"))
    even = F.bit_count("cell") % 2 == 0
    probes = halves.select(
        F.col("fp").alias("a"), F.col("vec").alias("va"), "side", F.col("cell").alias("own"),
        F.explode(F.when(even, F.concat(F.array("cell"), _neighbours(F.col("cell"))))
                  .otherwise(F.array("cell"))).alias("cell"))
    posted = halves.select(F.col("fp").alias("b"), F.col("vec").alias("vb"),
                           F.col("side").alias("side_b"), F.col("cell").alias("cell_b"))
    met = probes.join(
        posted, (F.col("side") == F.col("side_b")) & (F.col("cell") == F.col("cell_b"))
        & ((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b")))
        & (F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))) <= max_bits)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(id, text_hash, fp, component_id)`` of every row.

    ``component_id`` is the smallest id that links reach, the row's own
    included. Null ids are passed over by that minimum; a group of null ids
    only has a null component. Null, empty and blank texts have fingerprint
    zero and are linked like any other. Repeated rows each keep a row.
    """
    sig = saved(fingerprints(docs, id_col, text_col, size))
    nodes = saved(sig.groupBy("fp").agg(F.min(id_col).alias("first")))
    star = components(links(nodes.select("fp"), max_bits))
    rooted = (nodes.join(star, nodes["fp"] == star["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "root", "component_id")
    return sig.join(of_fp, "fp").select(id_col, "text_hash", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, that with the smallest id.

    All columns are kept, whatever their names. Rows with a null id come last; of rows that share
    that id, the one with the smallest text hash, and one of repeated rows.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    g = groups(plain, "id", "text", size, max_bits)
    first = (g.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("s"), F.count("*").alias("n"))
             .select(F.col("s.id").alias("f_id"), F.col("s.text_hash").alias("f_hash"), "n"))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"),
                        text_hash(text_col).alias("hash"))
    kept = named.join(first, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash")))
    # A group of one row has no repeated rows to choose from.
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1)))
    several = kept.filter("n > 1").withColumn("nth", nth).filter("nth = 1")
    return kept.filter("n = 1").select("row").unionByName(several.select("row")).select("row.*")
