"""Accounts / posts / labels derived from the driver's generic tables.

The driver tables carry no account/post model, so one is derived with
expressions that mean the same in Spark and in the SQL oracle:

* ``accounts``  one row per ``customer`` (profile fields planted from the
  key so every profile rule and feature is exercised),
* ``posts``     one row per ``events`` row; the post text is the **whole**
  ``documents`` text the event points at (``doc_id = event_id % #docs``),
  with planted prefixes/suffixes (prompt leak, URL typo, bait, hashtags),
* ``labels``    authors planted as automated: ``user_id % 5 = 0`` (their
  even events are click-bait posts with a short link).

``dataset_id = 30 + key % 4``; datasets 30/32 are English, 31/33 French.
All work grows with the driver tables: nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    oc = (_read(spark, sf_dir, "orders").groupBy("o_custkey")
          .agg(F.count(F.lit(1)).alias("n_orders")))
    k = F.col("c_custkey")
    nat = F.col("n_name")
    name = (F.when(k % 29 == 3, F.concat(F.col("c_name"), F.lit("\x07")))
            .when(k % 7 == 1, F.lit("Ada Byron"))
            .when(k % 7 == 2, F.lit("Bob 🤖"))
            .otherwise(F.col("c_name")))
    username = (F.when(k % 3 == 0, F.concat(F.lit("ab_cd"), k.cast("string")))
                .when(k % 3 == 1, F.concat(F.lit("User"), k.cast("string")))
                .otherwise(F.lit("plain")))
    description = (F.when(k % 4 == 0, F.lit(None).cast("string"))
                   .when(k % 4 == 1, F.concat(F.col("c_mktsegment"), F.lit(" | "), nat,
                                              F.lit(" | #x")))
                   .when(k % 4 == 2, F.concat(F.lit("see http://a.example\n"), nat))
                   .otherwise(F.lit("")))
    location = (F.when(k % 23 == 0, F.concat(F.lit("O:"), nat, F.lit(":O")))
                .when(k % 23 == 1, F.lit(":null:"))
                .when(k % 23 == 2, F.lit(None).cast("string"))
                .otherwise(nat))
    tweet_count = F.when(k % 5 == 1, F.lit(None).cast("long")).otherwise(
        F.col("n_orders").cast("long"))
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .join(oc, c.c_custkey == oc.o_custkey, "left")
            .select((F.lit(30) + k % 4).cast("long").alias("dataset_id"),
                    k.cast("long").alias("id"),
                    name.alias("name"), username.alias("username"),
                    description.alias("description"), location.alias("location"),
                    tweet_count.alias("tweet_count"),
                    (F.col("c_acctbal") / 1000.0).alias("z_score")))


def account_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of ``accounts`` alone, for what only asks whether an account is known."""
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select((F.lit(30) + k % 4).cast("long").alias("dataset_id"), k.cast("long").alias("id"))


# Planted post suffixes by kind (fixture constants).
_SUFFIX = {
    "click": " Click https://t.co/x1",
    "signup": " DM me! #Love #Été",
    "error": " @mention why...?",
    "purchase": " just got 🤖 NASA iPhone THe lol",
}
LEAK_PREFIX = "Here are some of my recent tweets: "
TYPO_SUFFIX = " htts://x.example/z"


def post_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts without their texts: keys, instant, language and what the text is made of."""
    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    u = F.col("user_id")
    return ev.select((F.lit(30) + u % 4).cast("long").alias("dataset_id"),
                     F.col("event_id").cast("long").alias("post_seq"),
                     u.cast("long").alias("author_id"),
                     F.col("ts").alias("created_at"),
                     F.when(u % 2 == 0, F.lit("en")).otherwise(F.lit("fr")).alias("lang"),
                     "event_type")


def with_text(spark: SparkSession, sf_dir: str, keyed: DataFrame) -> DataFrame:
    """Rows of ``post_keys`` with their texts.

    Rows that are not needed are best dropped before: from here on they carry whole texts.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    # One scalar from Parquet metadata; the join itself is a shuffle join.
    ndocs = docs.count()
    e, u = F.col("post_seq"), F.col("author_id")
    kind = F.when((u % 5 == 0) & (e % 2 == 0), F.lit("click")).otherwise(F.col("event_type"))
    suffix = F.lit("")
    for k, s in reversed(list(_SUFFIX.items())):
        suffix = F.when(kind == k, F.lit(s)).otherwise(suffix)
    text = F.concat(
        F.when(e % 997 == 5, F.lit(LEAK_PREFIX)).otherwise(F.lit("")),
        F.coalesce(F.col("text"), F.lit("")),
        F.when(e % 991 == 7, F.lit(TYPO_SUFFIX)).otherwise(F.lit("")),
        suffix)
    # By number, or small keys would be coalesced into a few tasks that then hold all the texts.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.withColumn("doc_key", e % F.lit(ndocs)).repartition(tasks, "doc_key")
    return (keyed.join(docs, keyed.doc_key == docs.doc_id, "left")
            .select("dataset_id", "post_seq", "author_id", "created_at", "lang", text.alias("text")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(spark, sf_dir, post_keys(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").select("user_id")
    return (ev.where(F.col("user_id") % 5 == 0)
            .select((F.lit(30) + F.col("user_id") % 4).cast("long").alias("dataset_id"),
                    F.col("user_id").cast("long").alias("author_id"))
            .distinct())
