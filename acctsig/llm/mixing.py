"""Mixing sources to target weights by systematic sampling.

Each source's target is a share of the words of all documents. Within a
source every document expects target / size copies. Documents are put in
order of size (so that each source's words come near its target whatever the
sizes are), their expected copies are summed up from one random offset, and
a document is taken once for each integer that its interval crosses. The
sums are exact at any scale, as the expected copies are equal within a
source: the sum before the n-th document is n times them.

A document's number within its source is found in two levels: rows are
range-partitioned by (source, size, digest, id), counted per partition and
source, and numbered within those from the counts before them. So a source,
or one size, that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsig.llm.common import saved, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a digest of the parts; equal in every run."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes. A target stops at ``most`` times its source's size, and
    the excess is shared anew by weight until none is above. That fixed point
    is min(weight * level, most * size) at the one level where the targets
    make up the sum: with the sources ordered by most * size / weight, the
    first ones stop and the level follows from the rest. The windows run over
    one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = per.withColumn("nth", order).withColumn(
        "weight", F.element_at(F.array(*(F.lit(x).cast("long") for x in weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(1))
    stop = F.lit(most) * F.col("source_size")
    by_stop = Window.orderBy(stop / F.col("weight"), "nth")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    after = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level if exactly the sources before this one stop; it holds for the first source that stays below its stop.
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum(stop).over(before), F.lit(0)))
             / F.sum("weight").over(after))
    w = w.withColumn("level", level)
    level = F.coalesce(F.min(F.when(F.col("weight") * F.col("level") <= stop, F.struct(stop / F.col("weight"), "nth", "level")))
                       .over(every)["level"], F.lit(0.0))
    return w.select("source", "source_size", "n_rows",
                    F.least(F.col("weight") * level, stop.cast("double")).alias("target"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows(id, source, size, ..)`` with ``nth``, from 0, in the order (size, digest of the id, id, ..) within the source."""
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    keys = ["size", "digest", "id", *sorted(set(rows.columns) - {"id", "source", "size"})]
    dealt = saved(rows.withColumn("digest", digest).repartitionByRange(F.col("source").asc_nulls_last(), *keys)
                  .withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = counts.select("source", "part", (F.sum("n").over(
        Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part", "source").orderBy(*keys)
    local = dealt.withColumn("local", F.row_number().over(within) - 1)
    b = before.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), "before")
    return (local.join(b, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source")))
            .withColumn("nth", F.col("before") + F.col("local"))
            .drop("b_source", "b_part", "before", "local", "part", "digest"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``(id, text_hash, size, source, source_size, target, copies)`` of every row.

    Null texts have size 0; a source without words has the target 0 and is
    not taken. Null is a source like any other. Repeated rows are documents of
    their own. The same rows give the same copies in every run. No document
    is taken more than ``most`` times, as no target is above ``most`` times
    its source.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    placed = numbered(rows)
    of_source = targets(placed.select("source", "size"), weights, most)
    t = (of_source.withColumnRenamed("source", "t_source")
         .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
         .withColumn("offset", _unit(F.lit(seed), F.col("t_source"))).drop("n_rows"))
    crossed = lambda n: F.floor(F.col("offset") + n * F.col("rate"))
    return (placed.join(t, F.col("source").eqNullSafe(F.col("t_source")))
            .withColumn("copies", crossed(F.col("nth") + 1) - crossed(F.col("nth")))
            .select(F.col("id").alias(id_col), "text_hash", "size", F.col("source").alias(source_col),
                    "source_size", "target", "copies"))


def resampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, each as often as the mix takes it.

    Repeated rows (equal id and text) share their copies out; only they are numbered in a window.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    m = (mixed(plain, "id", "text", "source", **how).groupBy(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash"))
         .agg(F.sum("copies").alias("copies"), F.count("*").alias("n_rows")))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"),
                      F.xxhash64(F.col(text_col)).alias("hash"))
    joined = own.join(m, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("hash") == F.col("m_hash"))).filter("copies > 0")
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1)))
    share = F.floor(F.col("copies") / F.col("n_rows")) + F.when(nth <= F.col("copies") % F.col("n_rows"), 1).otherwise(0)
    once = joined.filter("n_rows = 1").select("row", F.col("copies").cast("int").alias("n"))
    often = joined.filter("n_rows > 1").select("row", share.cast("int").alias("n"))
    return (once.unionByName(often).select("row", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n")))).alias("take"))
            .select("row.*"))
