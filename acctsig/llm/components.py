"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctsig.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = (e.join(least, "u").filter("v > m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``, root being the
    smallest node of its component; a root itself has no row.

    Alternating large-star and small-star steps keep the number of edges at
    most that of the input and need a logarithmic number of rounds. Every
    round is aggregations (with map-side partials) and joins that AQE can
    split; it is written to the checkpoint folder, so a lost executor costs
    one round at most. Only the three check figures of a round reach the
    driver.
    """
    e = saved(links.filter("a <> b")
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                    F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(now) == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)
        e = saved(_small_star(_large_star(e)))
