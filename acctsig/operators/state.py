"""Mergeable account state (A1–A4, H1–H6, W2–W5): partial results per account and day.

Posts that arrive add a day's partial rows to a table; an account's figures come
from merging its rows, so posts seen before are not read again. A row holds the
post count, sums, maxima and sums of squares of the post signals, first and last
instant, 24 hour counters, and a HyperLogLog sketch of the distinct hashtags. All
but the sketch are exact: integer signals are summed as integers, and the
variance is (n Σx² - (Σx)²) / n² in whole numbers, so merged rows give what one
aggregation over all posts gives. The sketch's relative standard error is
1.04 / sqrt(2 ** ``SKETCH_BITS``), 1.6 %.

Every step is an aggregation with map-side partials. Posts that arrive twice count
twice; deduplicate them first (S9). A null instant counts for no hour and day null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsig.operators import temporal as temp
from acctsig.operators.post import POST_NUMERIC
from acctsig.operators.rollup import DISPERSION

KEYS = ("dataset_id", "author_id")
SKETCH_BITS = 12
HOURS = [f"_h{h}" for h in range(24)]


def _merges() -> list:
    """How the columns of partial rows are merged."""
    adds = ["n_posts", *(f"{k}_sum" for k in POST_NUMERIC), *(f"{k}_squares" for k in DISPERSION), *HOURS]
    return [*(F.sum(c).alias(c) for c in adds), *(F.max(f"{k}_max").alias(f"{k}_max") for k in DISPERSION),
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
            F.hll_union_agg("tags").alias("tags")]


def daily_state(post_feats: DataFrame, ts: str = "created_at", hour: str | None = None, keys=KEYS) -> DataFrame:
    """Partial rows per account and day from posts with their signals (``post.post_features``)."""
    h = temp.utc_hour(post_feats, ts) if hour is None else F.col(hour)
    timed = post_feats.withColumns({"us": temp.epoch_micros(post_feats, ts), "hour": h})
    day = F.floor(F.col("us") / F.lit(temp.DAY_MICROS)).alias("day")
    by = [F.col(k) for k in keys] + [day]
    state = timed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_posts"), *(F.sum(k).alias(f"{k}_sum") for k in POST_NUMERIC),
        *(F.sum(F.col(k).cast("decimal(20,0)") * F.col(k).cast("decimal(10,0)")).cast("decimal(38,0)").alias(f"{k}_squares") for k in DISPERSION),
        *(F.max(k).alias(f"{k}_max") for k in DISPERSION), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        *(F.count_if(F.col("hour") == i).alias(c) for i, c in enumerate(HOURS)))
    tags = (timed.select(*by, F.explode("hashtags").alias("tag")).groupBy(*keys, "day")
            .agg(F.hll_sketch_agg("tag", SKETCH_BITS).alias("tags")))
    same = [state[k].eqNullSafe(tags[k]) for k in (*keys, "day")]
    return state.join(tags, same, "left").select(*(state[c] for c in state.columns), tags["tags"])


def merged(state: DataFrame, keys=KEYS, by_day: bool = False) -> DataFrame:
    """One row per account (or account and day) from any number of partial rows."""
    return state.groupBy(*keys, *(["day"] if by_day else [])).agg(*_merges())


def arrive(state: DataFrame, path: str) -> None:
    """Append partial rows to the table below ``path``."""
    state.write.mode("append").parquet(path)


def compacted(spark: SparkSession, path: str, to: str, keys=KEYS) -> None:
    """The table below ``path`` with one row per account and day, written to ``to``."""
    merged(spark.read.parquet(path), keys, by_day=True).write.parquet(to)


def rollup(state: DataFrame, keys=KEYS) -> DataFrame:
    """A1–A4 and the post count from merged rows."""
    n = F.col("n_posts")
    out = []
    for k in POST_NUMERIC:
        out += [(F.col(f"{k}_sum") / n).alias(f"{k}_mean"), F.col(f"{k}_sum")]
        if k in DISPERSION:
            whole = F.col(f"{k}_sum").cast("decimal(18,0)")
            spread = n.cast("decimal(18,0)") * F.col(f"{k}_squares").cast("decimal(20,0)") - whole * whole
            out += [(F.sqrt(spread.cast("double")) / n).alias(f"{k}_std"), F.col(f"{k}_max")]
    return state.select(*keys, "n_posts", *out)


def hours(state: DataFrame, keys=KEYS) -> DataFrame:
    """Hour entropy, night ratio and active hours from merged rows."""
    return temp.hour_features(state.withColumnRenamed("n_posts", "n"), keys)


def hashtags(state: DataFrame, keys=KEYS) -> DataFrame:
    """H1–H6 from merged rows, the distinct hashtags estimated."""
    total, n = F.col("hashtag_count_sum"), F.col("n_posts")
    unique = F.coalesce(F.hll_sketch_estimate("tags"), F.lit(0))
    return state.select(
        *keys, total.cast("long").alias("total_hashtags"), unique.alias("unique_hashtags"),
        (unique / F.greatest(total, F.lit(1))).alias("hashtag_diversity"), (total / n).alias("hashtag_per_post"),
        F.col("hashtag_count_max").cast("long").alias("max_hashtags_per_tweet"),
        (F.col("has_hashtag_sum") / n).alias("hashtag_post_ratio"))
