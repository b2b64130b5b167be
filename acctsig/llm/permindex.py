"""Nearest neighbours by a permutation index.

``PIVOTS`` distinct vectors, the first by a digest of their ids (a sample of
fixed size, all that the index is fitted on), order every vector: its permutation
lists its ``PREFIX`` nearest pivots. Vectors are dealt to shards of about
``SHARD`` rows. In a shard each pivot's inverted file posts the vectors that
list it, with the place where they do. A query reads the files of its own
nearest pivots and so accumulates its footrule distance to the shard's
vectors (a pivot that one of the two does not list counts as place
``PREFIX``). The ``share`` of the shard's distinct vectors that lie nearest,
but at least ``least``, are reranked by their exact distances. Each shard passes on
its best k, of which the best k overall are kept.

Queries are joined to the shards in blocks: a task holds one shard and one
block of queries, however many there are of either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm.common import prepare, saved

PIVOTS = 128
PREFIX = 128
SHARD = 16_384
QUERY_BLOCK = 2_048
SHARE = 0.25
LEAST = 2_000


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)``, v in double precision, of the vectors that take part.

    Null, empty and zero vectors, those with a null or non-finite component,
    and rows without an id take no part. Of rows that share an id the
    smallest vector (component by component) stands for it.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
                    & F.exists(v, lambda x: x != 0))
            .groupBy("id").agg(F.min("v").alias("v")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector its nearest pivots in order; equal distances by the pivots' order."""
    d = (pivots ** 2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


class Shard:
    """The pivots' inverted files over the distinct vectors of one shard.

    Copies of a vector are posted once, with their ids in order, so that a
    vector with very many of them does not use up the candidates of a query.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        as_bytes = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, copy_of = np.unique(as_bytes, return_index=True, return_inverse=True)
        by_vector = np.lexsort((ids, copy_of))
        self.ids, self.vectors, self.prefix = ids[by_vector], vectors[first], min(prefix, len(pivots))
        self.first_id = np.searchsorted(copy_of[by_vector], np.arange(len(first) + 1))
        order = permutations(self.vectors, pivots, self.prefix)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.members = (by_pivot // self.prefix).astype(np.int32)
        self.places = (by_pivot % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, permutation: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's permutation to every distinct vector of the shard.

        Without a common pivot it is twice the sum of (prefix - place). Each
        posting of one of the query's pivots puts |place - place'| for the
        two terms that stand for the pivot being unlisted on either side.
        """
        l = self.prefix
        gain = np.zeros(len(self.vectors), np.int64)
        for place, pivot in enumerate(permutation.tolist()):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            there = self.places[a:b]
            gain[self.members[a:b]] += (l - place) + (l - there) - np.abs(place - there)
        return l * (l + 1) - gain

    def nearest(self, query_id, query: np.ndarray, permutation: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the best ``k`` among the ``n`` distinct vectors that lie nearest by footrule."""
        far = self.footrule(permutation)
        n = min(n + 1, len(far))  # the query's own vector may be among them
        # vectors as near as the last one all take part
        chosen = np.flatnonzero(far <= np.partition(far, n - 1)[n - 1])
        d = np.sqrt(((self.vectors[chosen] - query) ** 2).sum(axis=1))
        if len(d) > k:  # each gives an id at least, but for the query's own
            near = d <= np.partition(d, k)[k]
            chosen, d = chosen[near], d[near]
        ids = [self.ids[self.first_id[c]:min(self.first_id[c + 1], self.first_id[c] + k + 1)] for c in chosen.tolist()]
        d = np.repeat(d, [len(i) for i in ids])
        ids = np.concatenate(ids)
        other = ids != query_id
        ids, d = ids[other], d[other]
        best = np.lexsort((ids, d))[:k]
        return ids[best], d[best]


def searched(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
             pivots: int = PIVOTS, prefix: int = PREFIX, shard: int = SHARD, query_block: int = QUERY_BLOCK,
             share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``(query_id, rank, id, score)``: the nearest found of each row where ``is_query`` holds.

    ``is_query`` is a condition on the id. Nearness is the Euclidean distance
    in double precision; ties go to the smaller id. With fewer than ``k``
    other vectors all are returned. Vectors of another length than the most
    frequent one (of equally frequent ones the longest) take no part. An
    empty table gives no row.
    """
    spark = prepare(rows)
    all_rows = saved(usable(rows, id_col, vector_col))
    of_length = (all_rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
                 .orderBy(F.desc("n"), F.desc("dim")).limit(1).first())
    id_type = all_rows.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type),
                           T.StructField("score", T.DoubleType())])
    if of_length is None:
        return spark.createDataFrame([], schema).select(
            "query_id", F.lit(1).alias("rank"), F.col("vec_id").alias(id_col), "score")
    dim, total = of_length
    data = all_rows.filter(F.size("v") == dim)
    distinct = data.groupBy("v").agg(F.min("id").alias("id"))
    table = distinct.orderBy(F.xxhash64(F.col("id")), "id").limit(pivots).toArrow()
    sent = spark.sparkContext.broadcast(_matrix(table.column("v"), dim))

    queries = data.filter(is_query) if id_col == "id" else (
        data.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id"))
    shards = max(1, -(-total // shard))
    blocks = max(1, -(-queries.count() // query_block))
    h = F.xxhash64(F.col("id"), F.lit("deal"))
    data_of = data.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    query_of = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                              F.pmod(h, F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_numpy()
            own = Shard(ids, _matrix(left.column("v"), dim), sent.value, prefix)
            q = _matrix(right.column("v"), dim)
            n = max(least, k, int(np.ceil(share * len(own.vectors))))
            for query_id, query, perm in zip(right.column("id").to_numpy(), q, permutations(q, sent.value, own.prefix)):
                found, d = own.nearest(query_id, query, perm, k, n)
                out[0] += [query_id] * len(found)
                out[1].append(found)
                out[2].append(d)
        return pa.table({"query_id": pa.array(out[0], right.schema.field("id").type),
                         "vec_id": pa.array(np.concatenate(out[1]) if out[1] else [], right.schema.field("id").type),
                         "score": pa.array(np.concatenate(out[2]) if out[2] else [], pa.float64())})

    found = (data_of.groupBy("shard", "block").cogroup(query_of.groupBy("shard", "block"))
             .applyInArrow(run, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("vec_id").alias(id_col), "score"))
