"""Account profile features (P1–P20) and the interaction term.

Row-local expressions over the accounts table: no shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsig.functions import patterns as P
from acctsig.functions.text import NOT_WS, W_BODY, WS, WS_BODY, java_regex, tokens

PROFILE_COLUMNS = [
    "tweet_count", "z_score", "has_description", "has_location", "desc_len",
    "desc_word_count", "name_len", "username_len", "username_digit_ratio",
    "username_has_underscore", "profile_has_pipe", "profile_has_hashtag",
    "profile_has_emoji", "profile_has_url", "name_has_special_chars",
    "desc_has_newline", "desc_pipe_count", "desc_formulaic",
    "username_bot_pattern", "name_generic_pattern",
]

# Fixed patterns of the profile checks (Python re forms).
PROFILE_URL = r"http|\.com|\.org|\.net"
NAME_SPECIAL = r"[^\w\s.,!?'-]"
USERNAME_BOT = r"^[a-z]+_[a-z]+\d*$"
NAME_GENERIC = r"^[A-Z][a-z]+ [A-Z][a-z]+$"


def _s(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def profile_features(accounts: DataFrame, n_posts: Column | None = None,
                     id_col: str = "id") -> DataFrame:
    """P1–P20 for each account row (keeps ``dataset_id`` and ``id_col``).

    ``n_posts`` (a column of the input) is the fallback for a missing
    ``tweet_count``.
    """
    desc, name, user, loc = _s("description"), _s("name"), _s("username"), _s("location")
    tc = F.col("tweet_count").cast("long")
    if n_posts is not None:
        tc = F.coalesce(tc, n_posts.cast("long"))
    pipes = F.length(desc) - F.length(F.replace(desc, F.lit("|"), F.lit("")))
    digits = F.length(F.regexp_replace(user, r"\P{Nd}+", ""))
    # name.strip() matched against the generic pattern
    generic = name.rlike(f"^{WS}*[A-Z][a-z]+ [A-Z][a-z]+{WS}*\\z")
    return accounts.select(
        "*",
        tc.alias("tweet_count_f"),
        F.coalesce(F.col("z_score").cast("double"), F.lit(0.0)).alias("z_score_f"),
        desc.rlike(NOT_WS).cast("int").alias("has_description"),
        loc.rlike(NOT_WS).cast("int").alias("has_location"),
        F.length(desc).alias("desc_len"),
        F.size(tokens(desc)).alias("desc_word_count"),
        F.length(name).alias("name_len"),
        F.length(user).alias("username_len"),
        (digits / F.greatest(F.length(user), F.lit(1))).alias("username_digit_ratio"),
        user.contains("_").cast("int").alias("username_has_underscore"),
        (desc.contains("|") | name.contains("|")).cast("int").alias("profile_has_pipe"),
        desc.contains("#").cast("int").alias("profile_has_hashtag"),
        (desc.rlike(java_regex(P.PROFILE_EMOJI_PATTERN)) |
         name.rlike(java_regex(P.PROFILE_EMOJI_PATTERN))).cast("int").alias("profile_has_emoji"),
        desc.rlike(java_regex(PROFILE_URL)).cast("int").alias("profile_has_url"),
        name.rlike(f"[^{W_BODY}{WS_BODY}.,!?'\\-]").cast("int").alias("name_has_special_chars"),
        desc.contains("\n").cast("int").alias("desc_has_newline"),
        pipes.alias("desc_pipe_count"),
        (pipes >= 2).cast("int").alias("desc_formulaic"),
        user.rlike(java_regex(USERNAME_BOT)).cast("int").alias("username_bot_pattern"),
        generic.cast("int").alias("name_generic_pattern"),
    ).drop("tweet_count", "z_score").withColumnRenamed("tweet_count_f", "tweet_count") \
        .withColumnRenamed("z_score_f", "z_score")


def interaction(hour_entropy: Column, tweet_count: Column) -> Column:
    """Hour entropy x tweet count."""
    return (hour_entropy * tweet_count).alias("entropy_volume_interaction")
