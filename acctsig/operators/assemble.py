"""Feature assembly (F1–F5): one row of 106 features per eligible account.

Physical shape:

1. one per-post projection computes every text signal (T, the style flags
   of D, the rule flags of R) — the only full regex pass over the posts;
2. one hash aggregation per (dataset_id, author_id), with partial
   aggregation, produces A, H (additive part), D11–D22, the length moments
   and the rule flags;
3. small two-level aggregations for distinct hashtags, distinct first
   tokens and the length histogram (D17) read the same per-post table;
4. the packed word counts (D1–D5, D10, and the vocabulary and weights of X), the
   first-k-posts windows (D6, D7, D9) and the temporal deltas (W) each have their own shuffle;
5. the groups are joined on the account key; profile features (P) are
   row-local on the accounts.

``reuse`` controls how the per-post table of step 1 is shared by the
branches of step 2–3: ``"checkpoint"`` writes it to the shared checkpoint
folder (lineage cut, survives executor loss), ``"persist"`` keeps it in
executor memory/disk, ``None`` lets each branch recompute it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsig.functions import patterns as P
from acctsig.functions import wordcounts as wc
from acctsig.operators import lexical as lex
from acctsig.operators import post as post_ops
from acctsig.operators import profile as prof
from acctsig.operators import rollup as roll
from acctsig.operators import rules as rule_ops
from acctsig.operators import similarity as sim
from acctsig.operators import temporal as temp
from acctsig.sources import tables as src

KEYS = ("dataset_id", "author_id")
ROLLUP_COLUMNS = [
    name for k in post_ops.POST_NUMERIC
    for name in ([f"{k}_mean", f"{k}_sum"] +
                 ([f"{k}_std", f"{k}_max"] if k in roll.DISPERSION else []))]
HASHTAG_COLUMNS = ["total_hashtags", "unique_hashtags", "hashtag_diversity",
                   "hashtag_per_post", "max_hashtags_per_tweet", "hashtag_post_ratio"]
CROSS_COLUMNS = ["cross_user_sim_mean", "cross_user_sim_max"]
FEATURE_COLUMNS = (ROLLUP_COLUMNS + prof.PROFILE_COLUMNS + temp.TEMPORAL_COLUMNS +
                   lex.LEXICAL_COLUMNS + HASHTAG_COLUMNS + ["entropy_volume_interaction"] +
                   CROSS_COLUMNS)
assert len(FEATURE_COLUMNS) == 106, len(FEATURE_COLUMNS)


def reuse(df: DataFrame, mode: str | None) -> DataFrame:
    if mode == "checkpoint":
        return df.checkpoint(eager=True)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def post_signals(eposts: DataFrame, text: str = "text", lang: str = "lang",
                 seq: str = "post_seq", keys=KEYS, also: tuple[str, ...] = ()) -> DataFrame:
    """Step 1: every per-post signal in one projection (text dropped); ``also``: columns kept beside them."""
    pf = post_ops.post_features(eposts.select(*keys, seq, *also, lang, text), text=text, lang=lang,
                                extra=_extra_flags,
                                extra_literals=[*lex.STYLE_LITERALS, *rule_ops.LEAK_LITERALS], extra_words=lex.STYLE_WORDS)
    return pf.drop(text, lang)


def _extra_flags(t, low, cs, exotic):
    return lex.style_flag_columns(t, low, cs, exotic) + rule_ops.rule_flag_columns(t, low)


def account_aggregates(sig: DataFrame, keys=KEYS) -> DataFrame:
    """Step 2: the single per-account aggregation."""
    npunct = len(P.PUNCTUATION_CHARS)
    a = sig.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_posts"),
        *roll.rollup_columns(),
        F.avg("formal").alias("formality_score"),
        F.avg("slang").alias("slang_ratio"),
        F.avg("just_start").alias("just_starter_ratio"),
        F.avg("complete").alias("avg_sentence_completeness"),
        F.avg("has_url_text").alias("url_consistency"),
        F.avg("ai_phrase").alias("ai_phrase_ratio"),
        F.avg("mid_caps").alias("artificial_caps_ratio"),
        F.avg("generic_life").alias("generic_life_ratio"),
        F.avg("short_generic").alias("short_generic_ratio"),
        *[F.max(f"_p{i}").alias(f"_p{i}") for i in range(npunct)],
        F.max("leak").alias("any_leak"),
        F.max("typo").alias("any_typo"))
    pdiv = sum((F.col(f"_p{i}") for i in range(npunct)), F.lit(0))
    n = F.col("n_posts")
    return a.select(
        "*",
        pdiv.cast("long").alias("punctuation_diversity"),
        F.when(n >= 2, F.col("char_len_std") / F.greatest(F.col("char_len_mean"), F.lit(1.0)))
        .otherwise(F.lit(0.0)).alias("char_len_cv"),
        F.col("char_len_mean").alias("len_mean"),
    ).drop(*[f"_p{i}" for i in range(npunct)])


def feature_matrix(spark: SparkSession, accounts: DataFrame, posts: DataFrame,
                   labels: DataFrame | None = None, text: str = "text", lang: str = "lang",
                   seq: str = "post_seq", ts: str = "created_at", hour: str | None = None,
                   id_col: str = "id", keys=KEYS, reuse_mode: str | None = "persist",
                   median: str = "radix", block: int = 2048,
                   with_rules: bool = False, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """dataset_id, author_id, 106 features (+ label, + rule columns).

    ``texts`` adds the texts to rows of ``posts`` that come without them: then posts of
    unknown authors are dropped and the first posts are chosen before there are texts
    to move.
    """
    k = list(keys)
    keyed = src.eligible_posts(posts, accounts, id_col, keys)
    eposts = keyed if texts is None else texts(keyed)
    kept = lambda df: reuse(df, reuse_mode)
    # The instants come after the join with the texts, which may repeat rows.
    instants = (ts, hour) if hour else (ts,)
    sig = kept(post_signals(eposts, text, lang, seq, keys, instants))
    agg = kept(account_aggregates(sig, keys))
    hashtag = _hashtag_block(sig, agg, keys)
    uni = lex.length_uniformity(sig, agg, keys)
    first = lex.first_word_diversity(sig, keys)
    counts = kept(wc.packed_counts(eposts, text, keys))
    words = lex.word_features(counts.where(F.col("kind") == wc.TOKEN), keys)
    few = eposts if texts is None else texts(lex.first_posts(keyed, lex.FIRST_POSTS, [
        c for c in keyed.columns if c not in (*keys, seq)], keys, seq).drop("rn"))
    over = lex.overlaps(few, text, keys, seq)
    tmp = temp.temporal_features(sig.select(*keys, *instants), ts, hour, keys, median, kept=kept)
    cross = sim.cross_user_similarity(eposts, text, keys, block, counts.where(F.col("kind") == wc.TERM), agg.select(*keys))
    acc = accounts.select(F.col(keys[0]), F.col(id_col).alias(keys[1]), "name", "username",
                          "description", "location", "tweet_count", "z_score")
    j = (agg.join(acc, k).join(hashtag, k, "left").join(uni, k, "left")
         .join(first, k, "left").join(words, k, "left")
         .join(over, k, "left").join(tmp, k, "left")
         .join(cross, k, "left"))
    pf = prof.profile_features(j, F.col("n_posts"))
    out = pf.select("*", prof.interaction(F.col("hour_entropy"), F.col("tweet_count")))
    fill = {c: 0.0 for c in FEATURE_COLUMNS}
    fill["vocab_richness"] = -10000.0
    cols = [F.coalesce(F.col(c), F.lit(fill[c])).alias(c) for c in FEATURE_COLUMNS]
    extra = []
    if with_rules:
        extra = rule_ops.reason_columns(F.col("name"), F.col("location"),
                                        F.col("any_leak"), F.col("any_typo"))
    res = out.select(*k, *cols, *extra)
    if labels is not None:
        res = attach_labels(res, labels, keys)
    return res


def _hashtag_block(sig: DataFrame, agg: DataFrame, keys=KEYS) -> DataFrame:
    u = roll.distinct_hashtags(sig, keys)
    j = agg.select(*keys, "n_posts", F.col("hashtag_count_sum").alias("total"),
                   F.col("hashtag_count_max").alias("mx"),
                   F.col("has_hashtag_sum").alias("w")).join(u, list(keys), "left")
    uq = F.coalesce(F.col("unique_hashtags"), F.lit(0)).cast("long")
    return j.select(*keys, F.col("total").cast("long").alias("total_hashtags"),
                    uq.alias("unique_hashtags"),
                    (uq / F.greatest(F.col("total"), F.lit(1))).alias("hashtag_diversity"),
                    (F.col("total") / F.col("n_posts")).alias("hashtag_per_post"),
                    F.col("mx").cast("long").alias("max_hashtags_per_tweet"),
                    (F.col("w") / F.col("n_posts")).alias("hashtag_post_ratio"))


def attach_labels(df: DataFrame, labels: DataFrame, keys=KEYS) -> DataFrame:
    """label = 1 when the account id is in the label set."""
    lab = labels.select(*keys).distinct().withColumn("_lab", F.lit(1))
    return (df.join(lab, list(keys), "left")
            .withColumn("label", F.coalesce(F.col("_lab"), F.lit(0))).drop("_lab"))


def clean_features(df: DataFrame, cols: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """NULL, NaN, +inf, -inf -> 0 (as doubles)."""
    def fix(c):
        x = F.col(c).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        return F.when(bad, F.lit(0.0)).otherwise(x).alias(c)
    others = [c for c in df.columns if c not in set(cols)]
    return df.select(*others, *[fix(c) for c in cols])


def vectorize(df: DataFrame, cols: list[str] = FEATURE_COLUMNS,
              out: str = "features") -> DataFrame:
    """one vector column in the fixed feature order."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(
        clean_features(df, cols))
