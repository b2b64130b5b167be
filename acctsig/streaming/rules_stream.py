"""The deterministic rules on Structured Streaming.

The post-level rule signals (prompt leak, URL typo) and the per-post text
signals are stateless, so the same Column expressions run on a stream.
Per-author rule state is a watermarked event-time window aggregation; the
account-level rules (garbled name, location markers) come from a
stream-static join with the accounts table. Late posts beyond the
watermark are dropped by Spark, as for any windowed aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctsig.operators import rules as rule_ops

KEYS = ("dataset_id", "author_id")


def post_flags_stream(posts: DataFrame, text: str = "text") -> DataFrame:
    """Per-post leak/typo flags on a streaming (or batch) posts frame."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = posts.select("*", t.alias("_t")).select("*", F.lower("_t").alias("_low"))
    return base.select(*[c for c in posts.columns],
                       *rule_ops.rule_flag_columns(F.col("_t"), F.col("_low")))


def windowed_rule_hits(posts: DataFrame, accounts: DataFrame, ts: str = "created_at",
                       window: str = "1 day", watermark: str = "1 day",
                       id_col: str = "id") -> DataFrame:
    """Rule reasons per (author, event-time window), append-mode safe."""
    fl = post_flags_stream(posts).withWatermark(ts, watermark)
    agg = fl.groupBy(*KEYS, F.window(ts, window).alias("window")).agg(
        F.max("leak").alias("any_leak"), F.max("typo").alias("any_typo"),
        F.count(F.lit(1)).alias("n_posts"))
    acc = accounts.select(F.col(KEYS[0]), F.col(id_col).alias(KEYS[1]), "name", "location")
    j = agg.join(acc, list(KEYS))
    return j.select(*KEYS, "window", "n_posts",
                    *rule_ops.reason_columns(F.col("name"), F.col("location"),
                                             F.col("any_leak"), F.col("any_typo")))


def start(posts_stream: DataFrame, accounts: DataFrame, sink_path: str,
          checkpoint: str, trigger: str = "1 minute"):
    """Append detected (author, window, reason) rows to a Parquet sink."""
    hits = windowed_rule_hits(posts_stream, accounts).where(F.col("reason").isNotNull())
    return (hits.writeStream.outputMode("append").format("parquet")
            .option("path", sink_path).option("checkpointLocation", checkpoint)
            .trigger(processingTime=trigger).start())
