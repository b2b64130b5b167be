"""Per-post text signals: one narrow projection, no shuffle (per-character
counts come from one Arrow-batched vectorised pass, see functions.charstats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsig.functions import patterns as P
from acctsig.functions.charstats import Found, char_stats, sought, sought_words
from acctsig.functions.text import count_matches, gate_literals, gated_any, java_regex, safe_div

# Numeric per-post signals, in the order the account rollup aggregates them.
POST_NUMERIC = [
    "url_count", "hashtag_count", "mention_count", "emoji_count",
    "char_len", "word_count", "caps_ratio", "excl_count", "quest_count",
    "ellipsis_count", "has_bait", "has_generic_hashtag", "newline_count",
    "has_url", "has_hashtag", "has_mention",
]


def bait_flag(text: Column, lang: Column,
              en_patterns: list[str] = P.EN_BAIT_PATTERNS,
              other_patterns: list[str] = P.FR_BAIT_PATTERNS,
              low: Column | None = None, exotic: Column | None = None) -> Column:
    """1 when any bait pattern of the post's language matches (re.I)."""
    low = F.lower(text) if low is None else low
    en = gated_any(text, low, en_patterns, True, exotic)
    other = gated_any(text, low, other_patterns, True, exotic)
    return F.when(lang == F.lit("en"), en).otherwise(other).cast("int")


def generic_hashtag_flag(text: Column,
                         patterns: list[str] = P.GENERIC_HASHTAG_PATTERNS,
                         low: Column | None = None, exotic: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    return F.when(text.contains("#"), gated_any(text, low, patterns, True, exotic)) \
        .otherwise(F.lit(False)).cast("int")


def _gated_count(text: Column, pattern: str, *keys: str) -> Column:
    """``len(re.findall(pattern, s))``, skipped when no key literal occurs."""
    gate = None
    for k in keys:
        g = text.contains(k)
        gate = g if gate is None else (gate | g)
    return F.when(gate, count_matches(text, pattern)).otherwise(F.lit(0))


def post_features(posts: DataFrame, text: str = "text", lang: str = "lang",
                  en_bait: list[str] = P.EN_BAIT_PATTERNS,
                  other_bait: list[str] = P.FR_BAIT_PATTERNS,
                  generic_hashtags: list[str] = P.GENERIC_HASHTAG_PATTERNS,
                  extra=None, extra_literals=(), extra_words=()) -> DataFrame:
    """Append the 16 numeric post signals and the lower-cased ``hashtags``.

    NULL text is treated as ''. All columns are computed in one per-post
    projection; the per-character counts come from one vectorised pass
    (``acctsig.functions.charstats``). ``extra(text, lower_text, stats, exotic)`` may return
    more per-post columns to compute in the same projection; ``extra_literals`` and
    ``extra_words`` are what these look for in the lower-cased text.
    """
    # Shared inputs first: CollapseProject keeps a non-cheap alias that is
    # referenced more than once, so the hashtag list and the
    # per-character statistics are computed once per post.
    base = posts.select("*", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t0 = F.col("_t")
    literals = sought([*gate_literals([*en_bait, *other_bait, *generic_hashtags]), *extra_literals])
    words = sought_words(extra_words)
    base = base.select(
        "*",
        F.when(t0.contains("#"), F.regexp_extract_all(t0, F.lit(java_regex(P.HASHTAG_PATTERN)), 0))
        .otherwise(F.array().cast("array<string>")).alias("_tags"),
        char_stats(t0, literals, words).alias("_cs"))
    t, tags, cs = F.col("_t"), F.col("_tags"), F.col("_cs")
    low = Found(t, cs, literals, words)
    exotic = low.exotic()
    df = base.select(
        *[F.col(f"`{c}`") for c in posts.columns],
        _gated_count(t, P.URL_PATTERN, "http", "t.co/").alias("url_count"),
        F.size(tags).alias("hashtag_count"),
        _gated_count(t, P.MENTION_PATTERN, "@").alias("mention_count"),
        cs["emoji"].alias("emoji_count"),
        cs["char_len"].alias("char_len"),
        cs["words"].alias("word_count"),
        safe_div(cs["upper"], cs["alpha"]).alias("caps_ratio"),
        cs["excl"].alias("excl_count"),
        cs["quest"].alias("quest_count"),
        F.when(t.contains("..."), count_matches(t, r"\.\.\.")).otherwise(F.lit(0))
        .alias("ellipsis_count"),
        bait_flag(t, F.col(lang), en_bait, other_bait, low, exotic).alias("has_bait"),
        generic_hashtag_flag(t, generic_hashtags, low, exotic).alias("has_generic_hashtag"),
        cs["newline"].alias("newline_count"),
        F.transform(tags, lambda x: F.lower(x)).alias("hashtags"),
        *(extra(t, low, cs, exotic) if extra is not None else []),
    )
    return df.select(
        "*",
        (F.col("url_count") > 0).cast("int").alias("has_url"),
        (F.col("hashtag_count") > 0).cast("int").alias("has_hashtag"),
        (F.col("mention_count") > 0).cast("int").alias("has_mention"),
    )
