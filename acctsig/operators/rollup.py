"""Post -> account aggregates (A1–A4) and hashtag statistics (H1–H6).

All of A and the additive part of H are one hash aggregation with partial
(map-side) aggregation, so a hot author is combined before the shuffle.
The distinct-hashtag count is a two-level aggregation (distinct pairs,
then a count), never a collected set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctsig.operators.post import POST_NUMERIC

KEYS = ("dataset_id", "author_id")
DISPERSION = ("char_len", "word_count", "hashtag_count", "url_count")


def rollup_columns(numeric: list[str] = POST_NUMERIC,
                   dispersion: tuple[str, ...] = DISPERSION) -> list:
    """Aggregate expressions in feature order: mean, sum[, std, max] per signal."""
    out = []
    for k in numeric:
        out.append(F.avg(k).alias(f"{k}_mean"))
        out.append(F.sum(k).alias(f"{k}_sum"))
        if k in dispersion:
            out.append(F.stddev_pop(k).alias(f"{k}_std"))
            out.append(F.max(k).alias(f"{k}_max"))
    return out


def account_rollup(post_feats: DataFrame, keys=KEYS) -> DataFrame:
    """A1–A4 plus the post count, one row per account."""
    return post_feats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_posts"),
                                         *rollup_columns())


def distinct_hashtags(post_feats: DataFrame, keys=KEYS) -> DataFrame:
    """Number of distinct lower-cased hashtags per account (two-level agg)."""
    return (post_feats.select(*keys, F.explode("hashtags").alias("tag"))
            .distinct()
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_hashtags")))


def hashtag_stats(post_feats: DataFrame, keys=KEYS) -> DataFrame:
    """H1–H6, one row per account with posts."""
    base = post_feats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.sum("hashtag_count").alias("hashtag_count_sum"),
        F.max("hashtag_count").alias("hashtag_count_max"),
        F.sum("has_hashtag").alias("has_hashtag_sum"))
    return hashtag_ratios(base, post_feats, keys)


def hashtag_ratios(rollup: DataFrame, post_feats: DataFrame, keys=KEYS) -> DataFrame:
    """H1–H6 from an account rollup (its post count and hashtag sums) and the posts' hashtags."""
    j = rollup.select(*keys, "n_posts", "hashtag_count_sum", "hashtag_count_max", "has_hashtag_sum") \
        .join(distinct_hashtags(post_feats, keys), list(keys), "left")
    uniq = F.coalesce(F.col("unique_hashtags"), F.lit(0)).cast("long")
    total = F.col("hashtag_count_sum")
    return j.select(
        *keys, total.cast("long").alias("total_hashtags"), uniq.alias("unique_hashtags"),
        (uniq / F.greatest(total, F.lit(1))).alias("hashtag_diversity"),
        (total / F.col("n_posts")).alias("hashtag_per_post"),
        F.col("hashtag_count_max").cast("long").alias("max_hashtags_per_tweet"),
        (F.col("has_hashtag_sum") / F.col("n_posts")).alias("hashtag_post_ratio"))
