"""Text diversity and stylometry.

Shapes used, all keyed by (dataset_id, author_id):

* per-post flags (one projection) -> one aggregation with partial agg:
  D11–D15, D18–D22 and the length moments for D16;
* token table: explode lower-cased tokens -> count per (author, token)
  -> second aggregation: D1–D5; join with the fixed topic table: D10;
* first tokens: distinct (author, first token) -> count: D8;
* length histogram (author, length) joined with the mean length: D17;
* consecutive posts: ``row_number() <= k`` (Catalyst plans a
  WindowGroupLimit, so at most k posts per author and map partition cross
  the shuffle), then one Arrow group of at most k posts per author: D6, D7, D9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.functions import wordcounts as wc
from acctsig.functions import patterns as P
from acctsig.functions.charstats import Found, char_stats, sought, sought_words
from acctsig.functions.text import NOT_WS, WS, WS_CHARS, gate_literals, gated_any, pure_words, safe_div, word_set_any

KEYS = ("dataset_id", "author_id")
LEXICAL_COLUMNS = [
    "ttr", "hapax_ratio", "vocab_richness", "avg_word_len", "long_word_ratio",
    "content_jaccard_mean", "content_jaccard_std", "unique_first_words",
    "repeated_phrase_ratio", "topic_diversity", "formality_score", "slang_ratio",
    "just_starter_ratio", "avg_sentence_completeness", "punctuation_diversity",
    "char_len_cv", "tweet_len_uniformity", "url_consistency", "ai_phrase_ratio",
    "artificial_caps_ratio", "generic_life_ratio", "short_generic_ratio",
]
FIRST_TOKEN = f"^{WS}*({NOT_WS}+)"


def mid_caps_flag(cs: Column) -> Column:
    """1 when >= 2 whitespace tokens have an interior capital next to a
    lower-case letter (``cs`` is the per-character statistics struct)."""
    return (cs["mid_caps_tokens"] >= 2).cast("int")


def just_start_flag(t: Column) -> Column:
    """``re.match(r'^(just|Just)\\s', t.strip())`` without a regex pass."""
    s = F.ltrim(t, F.lit(WS_CHARS))
    nxt = F.substring(s, 5, 1)
    return (F.substring(s, 1, 4).isin("just", "Just") & (F.length(nxt) == 1)
            & (F.length(F.trim(nxt, F.lit(WS_CHARS))) == 0)
            & (F.length(F.rtrim(s, F.lit(WS_CHARS))) > 5)).cast("int")


def complete_flag(t: Column) -> Column:
    """Stripped post non-empty and ending in . ! or ?"""
    return F.substring(F.rtrim(t, F.lit(WS_CHARS)), -1, 1).isin(".", "!", "?").cast("int")


def style_flag_columns(t: Column, low: Column, cs: Column, exotic: Column | None = None) -> list[Column]:
    """Per-post style flags, the first token and 18 punctuation flags.

    ``t`` is the post text ('' for NULL), ``low`` its lower-case form (a column or
    ``charstats.Found``) and ``cs`` its per-character statistics, computed once;
    ``exotic`` is ``text.has_exotic_folds(low)``, if computed already.
    """
    punct = [F.when(t.contains(ch), F.lit(1)).otherwise(F.lit(0)).alias(f"_p{i}")
             for i, ch in enumerate(P.PUNCTUATION_CHARS)]
    first = F.regexp_extract(t, FIRST_TOKEN, 1)
    return [
        gated_any(t, low, [P.FORMAL_PATTERN], True, exotic).cast("int").alias("formal"),
        word_set_any(t, low, P.SLANG_PATTERN, exotic).cast("int").alias("slang"),
        just_start_flag(t).alias("just_start"),
        complete_flag(t).alias("complete"),
        (t.contains("http") | t.contains("t.co")).cast("int").alias("has_url_text"),
        gated_any(t, low, [P.AI_PHRASE_PATTERN], True, exotic).cast("int").alias("ai_phrase"),
        mid_caps_flag(cs).alias("mid_caps"),
        gated_any(t, low, [P.GENERIC_LIFE_PATTERN], True, exotic).cast("int").alias("generic_life"),
        ((F.length(t) < P.SHORT_POST_LEN) &
         ~(t.contains("http") | t.contains("@") | t.contains("#"))).cast("int")
        .alias("short_generic"),
        F.when(first == "", F.lit(None)).otherwise(F.lower(first)).alias("first_word"),
        *punct,
    ]


# What the style flags look for, to be found with the per-character statistics.
STYLE_LITERALS = gate_literals([P.FORMAL_PATTERN, P.AI_PHRASE_PATTERN, P.GENERIC_LIFE_PATTERN, *pure_words(P.SLANG_PATTERN)[1]])
STYLE_WORDS = pure_words(P.SLANG_PATTERN)[0]


def post_style_flags(posts: DataFrame, text: str = "text", keys=KEYS,
                     seq: str = "post_seq") -> DataFrame:
    """One row per post: the per-post style flags and the first token."""
    base = posts.select(*keys, F.col(seq).alias("seq"),
                        F.coalesce(F.col(text), F.lit("")).alias("_t"))
    literals, words = sought(STYLE_LITERALS), sought_words(STYLE_WORDS)
    t, cs = F.col("_t"), F.col("_cs")
    base = base.select("*", char_stats(t, literals, words).alias("_cs"))
    low = Found(t, cs, literals, words)
    return base.select(*keys, "seq", F.length(t).alias("char_len"), *style_flag_columns(t, low, cs, low.exotic()))


PUNCT_FLAGS = [f"_p{i}" for i in range(len(P.PUNCTUATION_CHARS))]


def style_aggregates() -> list[Column]:
    """Aggregates of the per-post style flags: D11–D15, D18–D22 and the punctuation marks seen."""
    return [
        F.avg("formal").alias("formality_score"),
        F.avg("slang").alias("slang_ratio"),
        F.avg("just_start").alias("just_starter_ratio"),
        F.avg("complete").alias("avg_sentence_completeness"),
        F.avg("has_url_text").alias("url_consistency"),
        F.avg("ai_phrase").alias("ai_phrase_ratio"),
        F.avg("mid_caps").alias("artificial_caps_ratio"),
        F.avg("generic_life").alias("generic_life_ratio"),
        F.avg("short_generic").alias("short_generic_ratio"),
        *[F.max(p).alias(p) for p in PUNCT_FLAGS],
    ]


def style_results(mean: Column, std: Column) -> list[Column]:
    """What follows from the aggregates: punctuation diversity and the length moments (D16, for D17)."""
    return [
        sum((F.col(p) for p in PUNCT_FLAGS), F.lit(0)).cast("long").alias("punctuation_diversity"),
        F.when(F.col("n_posts") >= 2, std / F.greatest(mean, F.lit(1.0)))
        .otherwise(F.lit(0.0)).alias("char_len_cv"),
        mean.alias("len_mean"),
    ]


def style_ratios(flags: DataFrame, keys=KEYS) -> DataFrame:
    """D11–D15, D18–D22 and the length moments, one aggregation."""
    a = flags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_posts"), *style_aggregates(),
                                 F.avg("char_len").alias("_mean"), F.stddev_pop("char_len").alias("_std"))
    return (a.select("*", *style_results(F.col("_mean"), F.col("_std")))
            .drop("_mean", "_std", *PUNCT_FLAGS))


def length_uniformity(flags: DataFrame, means: DataFrame, keys=KEYS,
                      tolerance: float = P.UNIFORM_TOLERANCE) -> DataFrame:
    """Share of posts within 50% of the mean length (1 for one post).

    Counts per (author, length) first, so the join carries one row per
    distinct length, not one per post.
    """
    h = flags.groupBy(*keys, "char_len").agg(F.count(F.lit(1)).alias("c"))
    j = h.join(means.select(*keys, "n_posts", "len_mean"), list(keys))
    near = F.abs(F.col("char_len") - F.col("len_mean")) < tolerance * F.col("len_mean")
    a = j.groupBy(*keys).agg(F.sum(F.when(near, F.col("c")).otherwise(F.lit(0))).alias("near"),
                             F.first("n_posts").alias("n_posts"))
    return a.select(*keys, F.when(F.col("n_posts") >= 2, F.col("near") / F.col("n_posts"))
                    .otherwise(F.lit(1.0)).alias("tweet_len_uniformity"))


def first_word_diversity(flags: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct lower-cased first tokens / posts (two-level agg)."""
    n = flags.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = (flags.where(F.col("first_word").isNotNull()).select(*keys, "first_word").distinct()
         .groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")))
    return (n.join(d, list(keys), "left")
            .select(*keys, (F.coalesce(F.col("_d"), F.lit(0)) / F.col("_n"))
                    .alias("unique_first_words")))


def token_counts(posts: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """(keys, token, c): lower-cased whitespace tokens counted per author."""
    return wc.of_kind(wc.word_counts(posts, text, keys, (wc.TOKEN,)), wc.TOKEN, "token", "c")


def richness(tc: DataFrame, keys=KEYS, long_len: int = P.LONG_WORD_LEN) -> DataFrame:
    """D1–D5 from the (author, token, count) table."""
    alpha = F.col("token").rlike(r"^\p{L}+$")
    ln = F.length("token")
    a = tc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vocab"),
        F.sum("c").alias("total"),
        F.count_if(F.col("c") == 1).alias("hapax"),
        F.sum(F.col("c") * F.col("c")).alias("m2"),
        F.sum(F.when(alpha, F.col("c")).otherwise(F.lit(0))).alias("n_alpha"),
        F.sum(F.when(alpha, F.col("c") * ln).otherwise(F.lit(0))).alias("len_alpha"),
        F.sum(F.when(alpha & (ln > long_len), F.col("c")).otherwise(F.lit(0))).alias("n_long"))
    return richness_ratios(a, keys)


RICHNESS = ["vocab", "total", "hapax", "m2", "n_alpha", "len_alpha", "n_long"]


def richness_ratios(a: DataFrame, keys=KEYS) -> DataFrame:
    """D1–D5 from the sums over each author's tokens."""
    total = F.greatest(F.col("total"), F.lit(1)).cast("double")
    return a.select(
        *keys,
        (F.col("vocab") / total).alias("ttr"),
        safe_div(F.col("hapax"), F.col("vocab")).alias("hapax_ratio"),
        (F.lit(10000.0) * (F.col("m2") - total) / F.greatest(total * total, F.lit(1.0)))
        .alias("vocab_richness"),
        F.when(F.col("n_alpha") > 0, F.col("len_alpha") / F.col("n_alpha"))
        .otherwise(F.lit(0.0)).alias("avg_word_len"),
        safe_div(F.col("n_long"), F.col("n_alpha")).alias("long_word_ratio"))


def word_sums(packed: DataFrame, keys=KEYS, long_len: int = P.LONG_WORD_LEN,
              topics: dict[str, list[str]] = P.TOPIC_KEYWORDS) -> DataFrame:
    """(keys, sums of D1–D5, topics touched) from packed token counts: no row per word."""
    def sums(c: wc.Counts):
        words, at, n = c.words.to_pylist(), c.starts()[:-1], c.n
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))[c.code]
        alpha = np.fromiter(map(str.isalpha, words), dtype=bool, count=len(words))[c.code]
        each = lambda x: np.add.reduceat(x, at)  # noqa: E731  every account has a word
        touched = [each(np.fromiter(map(set(ws).__contains__, words), dtype=bool, count=len(words))[c.code].astype(np.int64)) > 0
                   for ws in topics.values()]
        return [each(np.ones_like(n)), each(n), each((n == 1).astype(np.int64)), each(n * n), each(n * alpha), each(n * size * alpha),
                each(n * (alpha & (size > long_len))), sum(t.astype(np.int64) for t in touched)]

    return wc.account_sums(packed, keys, sums, [*RICHNESS, "_t"])


def word_features(packed: DataFrame, keys=KEYS, long_len: int = P.LONG_WORD_LEN,
                  topics: dict[str, list[str]] = P.TOPIC_KEYWORDS) -> DataFrame:
    """D1–D5 and D10 from packed token counts (``wordcounts.packed_counts``), one row per author with tokens."""
    sums = word_sums(packed, keys, long_len, topics).withColumn("topic_diversity", F.col("_t") / float(len(topics)))
    return richness_ratios(sums, (*keys, "topic_diversity"))


def topic_table(spark: SparkSession, topics: dict[str, list[str]] = P.TOPIC_KEYWORDS) -> DataFrame:
    rows = [(t, w) for t, ws in topics.items() for w in ws]
    return spark.createDataFrame(rows, "topic string, token string")


def topic_coverage(tc: DataFrame, spark: SparkSession, keys=KEYS,
                   topics: dict[str, list[str]] = P.TOPIC_KEYWORDS) -> DataFrame:
    """Share of the topic sets an author's tokens touch.

    The topic table is fixed (70 rows), so it is broadcast; the counts are read once.
    """
    rows = topic_table(spark, topics).groupBy("token").agg(
        *(F.max((F.col("topic") == t).cast("int")).alias(f"_t{i}") for i, t in enumerate(topics)))
    hit = tc.join(F.broadcast(rows), "token", "left").groupBy(*keys).agg(
        *(F.max(f"_t{i}").alias(f"_t{i}") for i in range(len(topics))))
    touched = sum((F.coalesce(f"_t{i}", F.lit(0)) for i in range(len(topics))), F.lit(0))
    known = F.lit(True)
    for k in keys:  # as a join of accounts and hits would have it, accounts with null keys have no hits
        known = known & F.col(k).isNotNull()
    return hit.select(*keys, (F.when(known, touched).otherwise(F.lit(0)) / float(len(topics))).alias("topic_diversity"))


def first_posts(posts: DataFrame, k: int, text: str | list[str] = "text", keys=KEYS,
                seq: str = "post_seq") -> DataFrame:
    """The first ``k`` posts of each author in file order, numbered 1..k.

    ``row_number() <= k`` alone in its window lets Catalyst insert a
    WindowGroupLimit before the shuffle, so a hot author sends at most k
    rows per map partition.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    kept = [text] if isinstance(text, str) else text
    return (posts.select(*keys, seq, *kept).withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= k))


def _overlaps_of(table: pa.Table, n_keys: int, pairs: int, anchors: int, lookahead: int) -> list:
    """What the first posts of one author share: columns (keys.., rn, text) -> D6, D7, D9."""
    rn, texts = table.column(n_keys).to_pylist(), table.column(n_keys + 1).to_pylist()
    word, post = wc.numbered([(texts[i] or "").lower() for i in np.argsort(rn)])
    n = len(texts)

    def distinct(item, of):
        """The distinct (item, post), by item, and how many of them each post has."""
        item, of = np.divmod(np.unique(item * n + of), n)
        return item, of, np.bincount(of, minlength=n)

    shares = []
    if pairs:
        item, of, size = distinct(word, post)
        next_to = (item[1:] == item[:-1]) & (of[1:] == of[:-1] + 1)
        both = np.bincount(of[:-1][next_to], minlength=n)
        either = size[:-1] + size[1:] - both[:-1]
        some = np.flatnonzero(either[:pairs])
        shares = both[some] / either[some]
    shared = compared = 0
    if anchors:
        inside = post[1:] == post[:-1]
        _, gram = np.unique(word[:-1][inside] * (int(word.max(initial=0)) + 1) + word[1:][inside], return_inverse=True)
        item, of, size = distinct(gram, post[1:][inside])
        some, at = size > 0, np.arange(n)
        for k in range(1, lookahead + 1):
            # an item's posts ascend, so one that is within reach is at most that many entries on
            near = (item[k:] == item[:-k]) & (of[k:] <= of[:-k] + lookahead) & (of[:-k] < anchors)
            shared += int(np.count_nonzero(near))
            compared += int(np.count_nonzero(some[k:] & some[:-k] & (at[:-k] < anchors)))
    return [float(np.mean(shares)) if len(shares) else 0.0, float(np.std(shares)) if len(shares) else 0.0, shared / max(compared, 1)]


# No post beyond these is compared with another one.
FIRST_POSTS = max(P.JACCARD_PAIRS + 1, P.BIGRAM_ANCHORS + P.BIGRAM_LOOKAHEAD)
OVERLAPS = ("content_jaccard_mean", "content_jaccard_std", "repeated_phrase_ratio")


def overlaps(posts: DataFrame, text: str = "text", keys=KEYS, seq: str = "post_seq", pairs: int = P.JACCARD_PAIRS,
             anchors: int = P.BIGRAM_ANCHORS, lookahead: int = P.BIGRAM_LOOKAHEAD) -> DataFrame:
    """D6, D7, D9, one row per author with posts: an author's first posts (a bounded number) are one Arrow group.

    No ``pairs`` or no ``anchors``: D6 and D7, or D9, are left at 0. The window that numbers
    the posts has dealt them out by author already, so the groups need no further exchange.
    """
    from acctsig.session import ship_package
    ship_package(posts.sparkSession)
    n_keys = len(keys)
    schema = T.StructType([*(T.StructField(k, posts.schema[k].dataType) for k in keys),
                           *(T.StructField(c, T.DoubleType()) for c in OVERLAPS)])

    def of_author(table: pa.Table) -> pa.Table:
        row = _overlaps_of(table, n_keys, pairs, anchors, lookahead)
        return pa.Table.from_arrays([*(table.column(i).slice(0, 1) for i in range(n_keys)), *(pa.array([x]) for x in row)],
                                    names=schema.names)

    k = max(pairs + 1 if pairs else 0, anchors + lookahead if anchors else 0)
    first = first_posts(posts, k, text, keys, seq).select(*keys, "rn", F.col(text))
    return first.groupBy(*keys).applyInArrow(of_author, schema)


def consecutive_jaccard(posts: DataFrame, text: str = "text", keys=KEYS,
                        seq: str = "post_seq", pairs: int = P.JACCARD_PAIRS) -> DataFrame:
    """Jaccard of token sets of posts (i, i+1) for the first pairs."""
    return overlaps(posts, text, keys, seq, pairs, 0, 0).select(*keys, "content_jaccard_mean", "content_jaccard_std")


def repeated_bigrams(posts: DataFrame, text: str = "text", keys=KEYS, seq: str = "post_seq",
                     anchors: int = P.BIGRAM_ANCHORS,
                     lookahead: int = P.BIGRAM_LOOKAHEAD) -> DataFrame:
    """Mean shared bigrams over pairs (i, i+1..i+4), i < min(n-1, 30)."""
    return overlaps(posts, text, keys, seq, 0, anchors, lookahead).select(*keys, "repeated_phrase_ratio")


def filled(name: str) -> Column:
    """A feature with the value that authors without a basis for it have.

    An author whose posts are all blank has no tokens: total words is
    max(0, 1) = 1, so vocab_richness is 10000 * (0 - 1) / 1. Others are 0.
    """
    empty = {"vocab_richness": -10000.0, "punctuation_diversity": 0}.get(name, 0.0)
    return F.coalesce(F.col(name), F.lit(empty)).alias(name)


def lexical_features(posts: DataFrame, spark: SparkSession, text: str = "text", keys=KEYS,
                     seq: str = "post_seq", flags: DataFrame | None = None,
                     tc: DataFrame | None = None) -> DataFrame:
    """D1–D22, one row per author with posts, in LEXICAL_COLUMNS order."""
    flags = post_style_flags(posts, text, keys, seq) if flags is None else flags
    tc = token_counts(posts, text, keys) if tc is None else tc
    sr = style_ratios(flags, keys)
    k = list(keys)
    out = (sr.join(richness(tc, keys), k, "left")
           .join(length_uniformity(flags, sr, keys), k, "left")
           .join(first_word_diversity(flags, keys), k, "left")
           .join(topic_coverage(tc, spark, keys), k, "left")
           .join(overlaps(posts, text, keys, seq), k, "left"))
    return out.select(*keys, *[filled(c) for c in LEXICAL_COLUMNS])
