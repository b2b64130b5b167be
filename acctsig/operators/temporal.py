"""Posting-rhythm features.

Consecutive-post deltas without a window over a whole author: posts are
split into (author, time bucket) groups, deltas are taken inside each
bucket with ``lag``, and the one delta that crosses from a bucket to the
next non-empty bucket comes from a small per-bucket (min, max) table. The
sorted time sequence is the same, so the delta multiset is exact, and a hot
author is spread over as many tasks as it has buckets.

Everything else is one hash aggregation with partial aggregation:
24 hour counters give entropy, night share and active hours without a
second grouping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.functions import patterns as P

KEYS = ("dataset_id", "author_id")
TEMPORAL_COLUMNS = [
    "inter_tweet_mean", "inter_tweet_std", "inter_tweet_cv", "inter_tweet_min",
    "inter_tweet_max", "inter_tweet_median", "posts_per_hour", "hour_entropy",
    "night_ratio", "rapid_fire_ratio", "regular_interval_ratio",
    "temporal_burstiness", "active_hours", "max_gap_ratio", "posting_span_hours",
]
HOUR_MICROS = 3_600_000_000
DAY_MICROS = 24 * HOUR_MICROS


def epoch_micros(posts: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column.

    A TIMESTAMP is an instant and keeps its own microseconds. The wall clock
    of a TIMESTAMP_NTZ is taken as UTC. Neither depends on the session's
    time zone.
    """
    if not isinstance(posts.schema[ts].dataType, T.TimestampNTZType):
        return F.unix_micros(ts)
    # Field by field: a difference of wall clocks would go through the session's zone.
    wall = F.col(ts)
    second = (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("long")
    return (F.unix_date(wall.cast("date")).cast("long") * DAY_MICROS + F.hour(wall).cast("long") * HOUR_MICROS
            + F.minute(wall).cast("long") * 60_000_000 + second)


def utc_hour(posts: DataFrame, ts: str) -> Column:
    """Hour of day in UTC (TIMESTAMP) or of the wall clock (TIMESTAMP_NTZ)."""
    return F.pmod(F.floor(epoch_micros(posts, ts) / F.lit(HOUR_MICROS)), F.lit(24)).cast("int")


def post_times(posts: DataFrame, ts: str = "created_at", hour: str | None = None,
               keys=KEYS) -> DataFrame:
    """(keys, us, hour): the instant in micros and the hour of day.

    ``hour`` names a column with the hour in the post's own offset; without
    it the hour is that of ``utc_hour``.
    """
    h = utc_hour(posts, ts) if hour is None else F.col(hour)
    return posts.select(*keys, epoch_micros(posts, ts).alias("us"), h.alias("hour"))


def deltas(times: DataFrame, keys=KEYS, bucket_micros: int = DAY_MICROS) -> DataFrame:
    """All consecutive deltas (micros) of each author's sorted times."""
    k = list(keys)
    b = times.select(*k, "us", F.floor(F.col("us") / F.lit(bucket_micros)).alias("bucket"))
    w_in = Window.partitionBy(*k, "bucket").orderBy("us")
    inner = (b.select(*k, (F.col("us") - F.lag("us").over(w_in)).alias("d"))
             .where(F.col("d").isNotNull()))
    edges = b.groupBy(*k, "bucket").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    w_b = Window.partitionBy(*k).orderBy("bucket")
    cross = (edges.select(*k, (F.col("lo") - F.lag("hi").over(w_b)).alias("d"))
             .where(F.col("d").isNotNull()))
    return inner.unionByName(cross)


def hour_profile(times: DataFrame, keys=KEYS,
                 night_last_hour: int = P.NIGHT_LAST_HOUR) -> DataFrame:
    """n, span and the hour-of-day features, one aggregation."""
    cnt = [F.count_if(F.col("hour") == h).alias(f"_h{h}") for h in range(24)]
    a = times.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 F.min("us").alias("first_us"), F.max("us").alias("last_us"),
                                 *cnt)
    return hour_features(a, keys, night_last_hour)


def hour_features(a: DataFrame, keys=KEYS, night_last_hour: int = P.NIGHT_LAST_HOUR) -> DataFrame:
    """The hour-of-day features from n and the counts of the hours, ``_h0`` to ``_h23``."""
    n = F.col("n").cast("double")
    ent = F.lit(0.0)
    active = F.lit(0)
    for h in range(24):
        c = F.col(f"_h{h}").cast("double")
        ent = ent - F.when(c > 0, (c / n) * F.log2(c / n)).otherwise(F.lit(0.0))
        active = active + (F.col(f"_h{h}") > 0).cast("int")
    night = sum((F.col(f"_h{h}") for h in range(night_last_hour + 1)), F.lit(0))
    return a.select(*keys, "n", "first_us", "last_us",
                    (ent + F.lit(0.0)).alias("hour_entropy"),
                    (night / n).alias("night_ratio"),
                    active.alias("active_hours"))


def radix_median(d: DataFrame, keys=KEYS, value: str = "d", bits: int = 18) -> DataFrame:
    """Exact per-group median of non-negative longs, without gathering a
    group in one task.

    Radix selection from the most significant digit: each round counts
    values per (group, prefix, digit) with partial aggregation, and a running
    sum over the digit rows of each (group, target) finds the digit that holds
    the target rank. From the second round on only values under a prefix
    that still holds a target are counted. Two targets (ranks
    floor((m-1)/2) and floor(m/2)) give the median (v1 + v2) / 2, the same
    double as a sorted median of integers.

    The second and third digits are ``bits`` wide and the first holds all that
    is above them, so a window has at most 2 ** bits rows for gaps under
    2 ** 54 microseconds (570 years), and longer gaps stay exact.

    A round's state is a row per group and prefix with what is left of the two
    ranks below it (null: that target is elsewhere). It is read once, by the next
    round, so the plan is a chain of rounds.
    """
    k = list(keys)
    v = F.col(value)
    digit = F.col("digit")
    state = None
    for shift in (2 * bits, bits, 0):
        if state is None:
            g = d.groupBy(*k, F.shiftrightunsigned(v, shift).alias("digit")).agg(F.count(F.lit(1)).alias("c"))
            whole = Window.partitionBy(*k)
            m = F.sum("c").over(whole)
            g = g.select(*k, F.lit(0).cast("long").alias("hi"), "digit", "c",
                         F.floor((m - 1) / 2).alias("r0"), F.floor(m / 2).alias("r1"))
            w = whole.orderBy("digit")
        else:
            under = d.select(*k, F.shiftrightunsigned(v, shift + bits).alias("hi"),
                             F.shiftrightunsigned(v, shift).bitwiseAND(F.lit((1 << bits) - 1)).alias("digit"))
            g = (under.join(state, k + ["hi"]).groupBy(*k, "hi", "digit")
                 .agg(F.count(F.lit(1)).alias("c"), F.max("r0").alias("r0"), F.max("r1").alias("r1")))
            w = Window.partitionBy(*k, "hi").orderBy("digit")
        below = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        g = g.withColumn("below", below)
        left = [F.when((F.col(r) >= F.col("below")) & (F.col(r) < F.col("below") + F.col("c")), F.col(r) - F.col("below")).alias(r)
                for r in ("r0", "r1")]
        state = (g.select(*k, F.shiftleft(F.col("hi"), bits).bitwiseOR(digit).alias("hi"), *left)
                 .where(F.col("r0").isNotNull() | F.col("r1").isNotNull()))
    found = F.array_compact(F.array(*(F.when(F.col(r).isNotNull(), F.col("hi").cast("double")) for r in ("r0", "r1"))))
    return state.select(*k, F.explode(found).alias("found")).groupBy(*k).agg(F.avg("found").alias("median"))


def delta_stats(d: DataFrame, hp: DataFrame, keys=KEYS, median: str = "radix",
                rapid_fire_seconds: float = P.RAPID_FIRE_SECONDS,
                tolerance: float = P.REGULAR_TOLERANCE) -> DataFrame:
    """Aggregates over the delta multiset of each author.

    The mean is known before the pass (span / (n - 1)), so the regularity
    count is in the same aggregation as everything else. ``median``:
    ``"radix"`` exact and skew-safe (default), ``"aggregate"`` Spark's exact
    ``median`` (buffers one author's values in one task), ``"approx"`` the
    bounded ``percentile_approx`` sketch.
    """
    mean_us = ((F.col("last_us") - F.col("first_us")) / (F.col("n") - 1))
    j = d.join(hp.where(F.col("n") >= 2).select(*keys, mean_us.alias("m")), list(keys))
    dd = F.col("d").cast("double")
    extra = []
    if median == "aggregate":
        extra = [(F.median("d") / 1e6).alias("inter_tweet_median")]
    elif median == "approx":
        extra = [(F.percentile_approx("d", 0.5, 10000).cast("double") / 1e6)
                 .alias("inter_tweet_median")]
    a = j.groupBy(*keys).agg(
        (F.avg(dd) / 1e6).alias("inter_tweet_mean"),
        (F.stddev_pop(dd) / 1e6).alias("inter_tweet_std"),
        (F.min("d") / 1e6).alias("inter_tweet_min"),
        (F.max("d") / 1e6).alias("inter_tweet_max"),
        *extra,
        F.avg((F.col("d") < F.lit(int(rapid_fire_seconds * 1_000_000))).cast("int"))
        .alias("rapid_fire_ratio"),
        F.avg(((F.col("m") > 0) & (F.abs(dd - F.col("m")) < tolerance * F.col("m")))
              .cast("int")).alias("regular_interval_ratio"))
    if median == "radix":
        med = radix_median(d, keys).select(*keys, (F.col("median") / 1e6)
                                           .alias("inter_tweet_median"))
        a = a.join(med, list(keys), "left")
    return a


def temporal_features(posts: DataFrame, ts: str = "created_at", hour: str | None = None,
                      keys=KEYS, median: str = "radix",
                      bucket_micros: int = DAY_MICROS, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """W0–W15, one row per author with posts (fewer than 2 posts -> zeros,
    ``active_hours`` = 1).

    ``kept`` may store a table that is read several times: the hour profile and the deltas.
    """
    times = post_times(posts, ts, hour, keys)
    hp = kept(hour_profile(times, keys))
    ds = delta_stats(kept(deltas(times, keys, bucket_micros)), hp, keys, median)
    j = hp.join(ds, list(keys), "left")
    two = F.col("n") >= 2
    span_s = F.greatest((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(1.0))
    mean, std = F.col("inter_tweet_mean"), F.col("inter_tweet_std")

    def z(c: Column) -> Column:
        return F.when(two, c).otherwise(F.lit(0.0))

    return j.select(
        *keys,
        z(mean).alias("inter_tweet_mean"),
        z(std).alias("inter_tweet_std"),
        z(std / F.greatest(mean, F.lit(1.0))).alias("inter_tweet_cv"),
        z(F.col("inter_tweet_min")).alias("inter_tweet_min"),
        z(F.col("inter_tweet_max")).alias("inter_tweet_max"),
        z(F.col("inter_tweet_median")).alias("inter_tweet_median"),
        z(F.col("n") / (span_s / 3600.0)).alias("posts_per_hour"),
        z(F.col("hour_entropy")).alias("hour_entropy"),
        z(F.col("night_ratio")).alias("night_ratio"),
        z(F.col("rapid_fire_ratio")).alias("rapid_fire_ratio"),
        z(F.col("regular_interval_ratio")).alias("regular_interval_ratio"),
        z((std - mean) / F.greatest(std + mean, F.lit(1.0))).alias("temporal_burstiness"),
        F.when(two, F.col("active_hours")).otherwise(F.lit(1)).cast("long").alias("active_hours"),
        z(F.col("inter_tweet_max") / span_s).alias("max_gap_ratio"),
        z(span_s / 3600.0).alias("posting_span_hours"),
    )
