"""Registered queries: name -> Spark DataFrame builder and its SQL oracle.

Every query reads the driver tables at ``sf_dir`` through the fixture
views (``acctsig.sources.fixture``) and runs over all rows and whole texts.
Integral outputs are BIGINT and fractional outputs DOUBLE rounded to 6
decimals in both engines, so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.functions import patterns as P
from acctsig.operators import post as post_ops
from acctsig.operators import rollup as rollup_ops
from acctsig.plans import oracle as O
from acctsig.sources import fixture as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ["dataset_id", "author_id"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# Exact in both engines (a median of integer microseconds is a multiple of
# 0.5 us): rounding would split ties differently, so these stay unrounded.
UNROUNDED = {"inter_tweet_median"}


def shape(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integral -> BIGINT, fractional -> DOUBLE rounded, for comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                                   T.BooleanType)):
            c = c.cast("long")
        elif f.name in UNROUNDED:
            c = c.cast("double")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Fixture access
# ---------------------------------------------------------------------------

def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted: small tables that several steps of a query read."""
    return asm.reuse(df, "persist")


def fixture_post_features(spark: SparkSession, sf: str) -> DataFrame:
    return post_ops.post_features(fx.posts(spark, sf))


# ---------------------------------------------------------------------------
# T: per-post signals
# ---------------------------------------------------------------------------

_PF = O.post_features_cte("pf")


@register("post_text_features", O.with_fixture(_PF) + """
SELECT dataset_id, post_seq, author_id,
  url_count, hashtag_count, mention_count, emoji_count, char_len, word_count,
  round(caps_ratio, 6) AS caps_ratio, excl_count, quest_count, ellipsis_count,
  has_bait, has_generic_hashtag, newline_count, has_url, has_hashtag, has_mention,
  array_to_string(hashtags, ' ') AS hashtags
FROM pf""")
def q_post_text_features(spark, sf):
    pf = fixture_post_features(spark, sf)
    return shape(pf.select("dataset_id", "post_seq", "author_id", *post_ops.POST_NUMERIC,
                           F.array_join("hashtags", " ").alias("hashtags")))


@register("post_bait_flags", O.with_fixture(_PF) + """
SELECT dataset_id, lang, count(*) AS n_posts,
  CAST(sum(has_bait) AS BIGINT) AS bait_posts,
  CAST(sum(has_generic_hashtag) AS BIGINT) AS generic_hashtag_posts
FROM pf GROUP BY dataset_id, lang""")
def q_post_bait_flags(spark, sf):
    pf = fixture_post_features(spark, sf)
    return shape(pf.groupBy("dataset_id", "lang").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.sum("has_bait").alias("bait_posts"),
        F.sum("has_generic_hashtag").alias("generic_hashtag_posts")))


# ---------------------------------------------------------------------------
# A: post -> account rollup
# ---------------------------------------------------------------------------

def _rollup_sql() -> str:
    cols = []
    for k in post_ops.POST_NUMERIC:
        cols.append(O.r6(f"avg({k})", f"{k}_mean"))
        s = f"sum({k})"
        cols.append(O.r6(s, f"{k}_sum") if k == "caps_ratio" else O.i8(s, f"{k}_sum"))
    return ",\n  ".join(cols)


def _dispersion_sql() -> str:
    cols = []
    for k in rollup_ops.DISPERSION:
        cols.append(O.r6(f"stddev_pop({k})", f"{k}_std"))
        cols.append(O.i8(f"max({k})", f"{k}_max"))
    return ",\n  ".join(cols)


@register("author_post_rollup", O.with_fixture(_PF) + f"""
SELECT dataset_id, author_id, count(*) AS n_posts,
  {_rollup_sql()}
FROM pf GROUP BY dataset_id, author_id""")
def q_author_post_rollup(spark, sf):
    r = rollup_ops.account_rollup(fixture_post_features(spark, sf))
    return shape(r.select(*KEYS, "n_posts", *(f"{k}_{x}" for k in post_ops.POST_NUMERIC for x in ("mean", "sum"))))


@register("author_len_dispersion", O.with_fixture(_PF) + f"""
SELECT dataset_id, author_id,
  {_dispersion_sql()}
FROM pf GROUP BY dataset_id, author_id""")
def q_author_len_dispersion(spark, sf):
    r = rollup_ops.account_rollup(fixture_post_features(spark, sf))
    return shape(r.select(*KEYS, *(f"{k}_{x}" for k in rollup_ops.DISPERSION for x in ("std", "max"))))


# ---------------------------------------------------------------------------
# Eligible posts (S6) and the operators over them
# ---------------------------------------------------------------------------

from acctsig.operators import lexical as lex_ops  # noqa: E402
from acctsig.operators import profile as prof_ops  # noqa: E402
from acctsig.operators import rules as rule_ops  # noqa: E402
from acctsig.operators import similarity as sim_ops  # noqa: E402
from acctsig.operators import temporal as temp_ops  # noqa: E402
from acctsig.sources import tables as src  # noqa: E402


def fixture_ekeys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of the posts of known accounts."""
    return src.eligible_posts(fx.post_keys(spark, sf), fx.account_keys(spark, sf))


def fixture_eposts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of known accounts: told by their keys, so that no texts are dealt out by author for it."""
    return fx.with_text(spark, sf, fixture_ekeys(spark, sf))


def fixture_first_eposts(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The eligible posts that can be among an account's first ``k``, told by their keys before they have texts."""
    keyed = fixture_ekeys(spark, sf)
    return fx.with_text(spark, sf, lex_ops.first_posts(keyed, k, [c for c in keyed.columns if c not in (*KEYS, "post_seq")]).drop("rn"))


_EP = O.EPOSTS


@register("eligible_accounts", O.with_fixture(_EP) + """
SELECT a.dataset_id, a.id, count(*) AS n_posts
FROM accounts a JOIN eposts p ON a.dataset_id = p.dataset_id AND a.id = p.author_id
GROUP BY ALL""")
def q_eligible_accounts(spark, sf):
    acc = fx.accounts(spark, sf)
    ea = src.eligible_accounts(acc, fx.posts(spark, sf))
    return shape(ea.select("dataset_id", "id", "n_posts"))


@register("temporal_intervals", O.with_fixture(_EP, O.TEMPORAL) + """
SELECT dataset_id, author_id,
  round(inter_tweet_mean, 6) AS inter_tweet_mean, round(inter_tweet_std, 6) AS inter_tweet_std,
  round(inter_tweet_cv, 6) AS inter_tweet_cv, round(inter_tweet_min, 6) AS inter_tweet_min,
  round(inter_tweet_max, 6) AS inter_tweet_max, inter_tweet_median,
  round(posts_per_hour, 6) AS posts_per_hour, round(posting_span_hours, 6) AS posting_span_hours,
  round(max_gap_ratio, 6) AS max_gap_ratio
FROM temporal""")
def q_temporal_intervals(spark, sf):
    t = temp_ops.temporal_features(fixture_eposts(spark, sf))
    return shape(t.select(*KEYS, "inter_tweet_mean", "inter_tweet_std", "inter_tweet_cv",
                          "inter_tweet_min", "inter_tweet_max", "inter_tweet_median",
                          "posts_per_hour", "posting_span_hours", "max_gap_ratio"))


@register("temporal_hours", O.with_fixture(_EP, O.TEMPORAL) + """
SELECT dataset_id, author_id, round(hour_entropy, 6) AS hour_entropy,
  round(night_ratio, 6) AS night_ratio, CAST(active_hours AS BIGINT) AS active_hours
FROM temporal""")
def q_temporal_hours(spark, sf):
    t = temp_ops.temporal_features(fixture_eposts(spark, sf))
    return shape(t.select(*KEYS, "hour_entropy", "night_ratio", "active_hours"))


@register("temporal_regularity", O.with_fixture(_EP, O.TEMPORAL) + """
SELECT dataset_id, author_id, round(rapid_fire_ratio, 6) AS rapid_fire_ratio,
  round(regular_interval_ratio, 6) AS regular_interval_ratio,
  round(temporal_burstiness, 6) AS temporal_burstiness
FROM temporal""")
def q_temporal_regularity(spark, sf):
    t = temp_ops.temporal_features(fixture_eposts(spark, sf))
    return shape(t.select(*KEYS, "rapid_fire_ratio", "regular_interval_ratio",
                          "temporal_burstiness"))


_STY = O.style_cte()
_TOK = O.tokens_cte()


@register("style_ratios", O.with_fixture(_EP, _STY) + """
SELECT dataset_id, author_id, round(formality_score, 6) AS formality_score,
  round(slang_ratio, 6) AS slang_ratio, round(just_starter_ratio, 6) AS just_starter_ratio,
  round(avg_sentence_completeness, 6) AS avg_sentence_completeness,
  round(url_consistency, 6) AS url_consistency, round(ai_phrase_ratio, 6) AS ai_phrase_ratio,
  round(generic_life_ratio, 6) AS generic_life_ratio,
  round(short_generic_ratio, 6) AS short_generic_ratio, round(char_len_cv, 6) AS char_len_cv
FROM sratio""")
def q_style_ratios(spark, sf):
    sr = lex_ops.style_ratios(lex_ops.post_style_flags(fixture_eposts(spark, sf)))
    return shape(sr.select(*KEYS, "formality_score", "slang_ratio", "just_starter_ratio",
                           "avg_sentence_completeness", "url_consistency", "ai_phrase_ratio",
                           "generic_life_ratio", "short_generic_ratio", "char_len_cv"))


@register("mid_caps", O.with_fixture(_EP, _STY) + """
SELECT dataset_id, author_id, round(artificial_caps_ratio, 6) AS artificial_caps_ratio
FROM sratio""")
def q_mid_caps(spark, sf):
    sr = lex_ops.style_ratios(lex_ops.post_style_flags(fixture_eposts(spark, sf)))
    return shape(sr.select(*KEYS, "artificial_caps_ratio"))


@register("punctuation_diversity", O.with_fixture(_EP, _STY) + """
SELECT dataset_id, author_id, CAST(punctuation_diversity AS BIGINT) AS punctuation_diversity
FROM sratio""")
def q_punctuation_diversity(spark, sf):
    sr = lex_ops.style_ratios(lex_ops.post_style_flags(fixture_eposts(spark, sf)))
    return shape(sr.select(*KEYS, "punctuation_diversity"))


@register("length_uniformity", O.with_fixture(_EP, _STY) + """
SELECT dataset_id, author_id, round(tweet_len_uniformity, 6) AS tweet_len_uniformity
FROM suni""")
def q_length_uniformity(spark, sf):
    fl = lex_ops.post_style_flags(fixture_eposts(spark, sf))
    return shape(lex_ops.length_uniformity(fl, lex_ops.style_ratios(fl)))


@register("first_word_diversity", O.with_fixture(_EP, _STY) + """
SELECT dataset_id, author_id, round(unique_first_words, 6) AS unique_first_words FROM sfirst""")
def q_first_word_diversity(spark, sf):
    fl = lex_ops.post_style_flags(fixture_eposts(spark, sf))
    return shape(lex_ops.first_word_diversity(fl))


@register("lexical_richness", O.with_fixture(_EP, _TOK) + """
SELECT dataset_id, author_id,
  round(vocab / greatest(total, 1), 6) AS ttr,
  round(hapax / greatest(vocab, 1), 6) AS hapax_ratio,
  round(10000.0 * (m2 - greatest(total, 1)) / greatest(greatest(total, 1) * greatest(total, 1), 1), 6)
    AS vocab_richness
FROM rich""")
def q_lexical_richness(spark, sf):
    r = lex_ops.richness(lex_ops.token_counts(fixture_eposts(spark, sf)))
    return shape(r.select(*KEYS, "ttr", "hapax_ratio", "vocab_richness"))


@register("lexical_words", O.with_fixture(_EP, _TOK) + """
SELECT dataset_id, author_id,
  round(CASE WHEN n_alpha > 0 THEN len_alpha / n_alpha ELSE 0 END, 6) AS avg_word_len,
  round(n_long / greatest(n_alpha, 1), 6) AS long_word_ratio
FROM rich""")
def q_lexical_words(spark, sf):
    r = lex_ops.richness(lex_ops.token_counts(fixture_eposts(spark, sf)))
    return shape(r.select(*KEYS, "avg_word_len", "long_word_ratio"))


@register("topic_coverage", O.with_fixture(_EP, _TOK, O.topics_cte()) + """
SELECT a.dataset_id, a.author_id,
  round(coalesce(h.nt, 0) / 7.0, 6) AS topic_diversity
FROM (SELECT DISTINCT dataset_id, author_id FROM tcnt) a
LEFT JOIN (SELECT dataset_id, author_id, count(DISTINCT topic) AS nt
           FROM tcnt JOIN topics USING (token) GROUP BY ALL) h USING (dataset_id, author_id)""")
def q_topic_coverage(spark, sf):
    return shape(lex_ops.topic_coverage(lex_ops.token_counts(fixture_eposts(spark, sf)), spark))


_RN = """
rn AS (SELECT dataset_id, author_id, text,
              row_number() OVER (PARTITION BY dataset_id, author_id ORDER BY post_seq) AS rn
       FROM eposts)
"""


@register("consecutive_jaccard", O.with_fixture(_EP, _RN, f"""
ts AS (SELECT dataset_id, author_id, rn,
              list_distinct({O.toks("lower(coalesce(text, ''))")}) AS ws FROM rn WHERE rn <= 41),
jp AS (SELECT a.dataset_id, a.author_id,
              len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) AS j
       FROM ts a JOIN ts b ON a.dataset_id = b.dataset_id AND a.author_id = b.author_id
            AND b.rn = a.rn + 1
       WHERE a.rn <= 40 AND len(list_distinct(list_concat(a.ws, b.ws))) > 0)
""") + """
SELECT a.dataset_id, a.author_id,
  round(coalesce(avg(j), 0), 6) AS content_jaccard_mean,
  round(coalesce(stddev_pop(j), 0), 6) AS content_jaccard_std
FROM (SELECT DISTINCT dataset_id, author_id FROM eposts) a
LEFT JOIN jp USING (dataset_id, author_id) GROUP BY ALL""")
def q_consecutive_jaccard(spark, sf):
    return shape(lex_ops.consecutive_jaccard(fixture_first_eposts(spark, sf, P.JACCARD_PAIRS + 1)))


@register("repeated_bigrams", O.with_fixture(_EP, _RN, f"""
tk AS (SELECT dataset_id, author_id, rn, {O.toks("lower(coalesce(text, ''))")} AS w
       FROM rn WHERE rn <= 34),
bg AS (SELECT dataset_id, author_id, rn,
              list_distinct(list_transform(range(1, len(w)),
                                           lambda i: w[i] || ' ' || w[i + 1])) AS b
       FROM tk),
cmp AS (SELECT a.dataset_id, a.author_id, len(list_intersect(a.b, c.b)) AS ov
        FROM bg a JOIN bg c ON a.dataset_id = c.dataset_id AND a.author_id = c.author_id
             AND c.rn BETWEEN a.rn + 1 AND a.rn + 4
        WHERE a.rn <= 30 AND len(a.b) > 0 AND len(c.b) > 0)
""") + """
SELECT a.dataset_id, a.author_id,
  round(coalesce(sum(ov), 0) / greatest(count(ov), 1), 6) AS repeated_phrase_ratio
FROM (SELECT DISTINCT dataset_id, author_id FROM eposts) a
LEFT JOIN cmp USING (dataset_id, author_id) GROUP BY ALL""")
def q_repeated_bigrams(spark, sf):
    return shape(lex_ops.repeated_bigrams(fixture_first_eposts(spark, sf, P.BIGRAM_ANCHORS + P.BIGRAM_LOOKAHEAD)))


_PFE = O.post_features_cte("pf").replace("FROM posts p)", "FROM eposts p)")


@register("hashtag_stats", O.with_fixture(_EP, _PFE) + """
SELECT b.dataset_id, b.author_id, CAST(b.total AS BIGINT) AS total_hashtags,
  CAST(coalesce(u.uq, 0) AS BIGINT) AS unique_hashtags,
  round(coalesce(u.uq, 0) / greatest(b.total, 1), 6) AS hashtag_diversity,
  round(b.total / b.n, 6) AS hashtag_per_post,
  CAST(b.mx AS BIGINT) AS max_hashtags_per_tweet,
  round(b.w / b.n, 6) AS hashtag_post_ratio
FROM (SELECT dataset_id, author_id, count(*) AS n, sum(hashtag_count) AS total,
             max(hashtag_count) AS mx, sum(has_hashtag) AS w FROM pf GROUP BY ALL) b
LEFT JOIN (SELECT dataset_id, author_id, count(DISTINCT tag) AS uq
           FROM (SELECT dataset_id, author_id, unnest(hashtags) AS tag FROM pf) GROUP BY ALL) u
USING (dataset_id, author_id)""")
def q_hashtag_stats(spark, sf):
    pf = post_ops.post_features(fixture_eposts(spark, sf))
    return shape(rollup_ops.hashtag_stats(pf))


_PROFILE_SQL = """
prof AS (
  SELECT a.dataset_id, a.id,
    coalesce(a.tweet_count, e.n_posts) AS tweet_count,
    coalesce(a.z_score, 0) AS z_score,
    CAST(regexp_matches(coalesce(a.description, ''), '{NWS}') AS BIGINT) AS has_description,
    CAST(regexp_matches(coalesce(a.location, ''), '{NWS}') AS BIGINT) AS has_location,
    length(coalesce(a.description, '')) AS desc_len,
    len({DTOK}) AS desc_word_count,
    length(coalesce(a.name, '')) AS name_len,
    length(coalesce(a.username, '')) AS username_len,
    len(regexp_extract_all(coalesce(a.username, ''), '\\p{{Nd}}'))
      / greatest(length(coalesce(a.username, '')), 1) AS username_digit_ratio,
    CAST(contains(coalesce(a.username, ''), '_') AS BIGINT) AS username_has_underscore,
    CAST(contains(coalesce(a.description, ''), '|') OR contains(coalesce(a.name, ''), '|') AS BIGINT)
      AS profile_has_pipe,
    CAST(contains(coalesce(a.description, ''), '#') AS BIGINT) AS profile_has_hashtag,
    CAST(regexp_matches(coalesce(a.description, '') || coalesce(a.name, ''), '{EMO}') AS BIGINT)
      AS profile_has_emoji,
    CAST(regexp_matches(coalesce(a.description, ''), 'http|\\.com|\\.org|\\.net') AS BIGINT)
      AS profile_has_url,
    CAST(regexp_matches(coalesce(a.name, ''), '[^{WB}{WSB}.,!?''\\-]') AS BIGINT)
      AS name_has_special_chars,
    CAST(contains(coalesce(a.description, ''), chr(10)) AS BIGINT) AS desc_has_newline,
    length(coalesce(a.description, '')) - length(replace(coalesce(a.description, ''), '|', ''))
      AS desc_pipe_count,
    CAST(length(coalesce(a.description, '')) - length(replace(coalesce(a.description, ''), '|', ''))
         >= 2 AS BIGINT) AS desc_formulaic,
    CAST(regexp_full_match(coalesce(a.username, ''), '[a-z]+_[a-z]+\\p{{Nd}}*\\n?') AS BIGINT)
      AS username_bot_pattern,
    CAST(regexp_full_match(coalesce(a.name, ''), '{WS}*[A-Z][a-z]+ [A-Z][a-z]+{WS}*') AS BIGINT)
      AS name_generic_pattern
  FROM accounts a JOIN (SELECT dataset_id, author_id, count(*) AS n_posts FROM eposts GROUP BY ALL) e
    ON a.dataset_id = e.dataset_id AND a.id = e.author_id)
""".format(NWS=O.NWS, WS=O.WS, WB=O.W_BODY, WSB=O.WS_BODY,
           DTOK=O.toks("coalesce(a.description, '')"),
           EMO=O.re2(P.PROFILE_EMOJI_PATTERN))


@register("profile_features", O.with_fixture(_EP, _PROFILE_SQL) + """
SELECT dataset_id, id, CAST(tweet_count AS BIGINT) AS tweet_count, round(z_score, 6) AS z_score,
  has_description, has_location, CAST(desc_len AS BIGINT) AS desc_len,
  CAST(desc_word_count AS BIGINT) AS desc_word_count, CAST(name_len AS BIGINT) AS name_len,
  CAST(username_len AS BIGINT) AS username_len,
  round(username_digit_ratio, 6) AS username_digit_ratio, username_has_underscore,
  profile_has_pipe, profile_has_hashtag, profile_has_emoji, profile_has_url,
  name_has_special_chars, desc_has_newline, CAST(desc_pipe_count AS BIGINT) AS desc_pipe_count,
  desc_formulaic, username_bot_pattern, name_generic_pattern
FROM prof""")
def q_profile_features(spark, sf):
    ea = src.eligible_accounts(fx.accounts(spark, sf), fx.posts(spark, sf))
    pf = prof_ops.profile_features(ea, F.col("n_posts"))
    return shape(pf.select("dataset_id", "id", *prof_ops.PROFILE_COLUMNS))


@register("interaction", O.with_fixture(_EP, O.TEMPORAL, _PROFILE_SQL) + """
SELECT p.dataset_id, p.id,
  round(t.hour_entropy * p.tweet_count, 6) AS entropy_volume_interaction
FROM prof p JOIN temporal t ON p.dataset_id = t.dataset_id AND p.id = t.author_id""")
def q_interaction(spark, sf):
    eposts = fixture_eposts(spark, sf)
    ea = src.eligible_accounts(fx.accounts(spark, sf), fx.posts(spark, sf))
    pf = prof_ops.profile_features(ea, F.col("n_posts")).select("dataset_id", "id", "tweet_count")
    t = temp_ops.temporal_features(eposts).select("dataset_id", F.col("author_id").alias("id"),
                                                  "hour_entropy")
    j = pf.join(t, ["dataset_id", "id"])
    return shape(j.select("dataset_id", "id",
                          prof_ops.interaction(F.col("hour_entropy"), F.col("tweet_count"))))


_RULES_SQL = """
rflags AS (
  SELECT dataset_id, author_id,
    max(CASE WHEN regexp_matches(lower(coalesce(text, '')), {LEAK}) THEN 1 ELSE 0 END) AS any_leak,
    max(CASE WHEN contains(coalesce(text, ''), 'htts://') OR contains(coalesce(text, ''), 'htt://')
             THEN 1 ELSE 0 END) AS any_typo
  FROM posts GROUP BY ALL),
rules AS (
  SELECT a.dataset_id, a.id AS author_id,
    regexp_matches(coalesce(a.name, ''), '[\\x{{00}}-\\x{{1F}}]') AS garbled_name,
    f.any_leak = 1 AS llm_leak,
    f.any_typo = 1 AS url_typo,
    contains(coalesce(a.location, ''), ':null:') OR contains(coalesce(a.location, ''), 'O:')
      OR contains(coalesce(a.location, ''), '.:') AS weird_location
  FROM accounts a JOIN rflags f ON a.dataset_id = f.dataset_id AND a.id = f.author_id),
rreason AS (
  SELECT *, CASE WHEN garbled_name THEN 'garbled_name' WHEN llm_leak THEN 'llm_leak'
                 WHEN url_typo THEN 'url_typo' WHEN weird_location THEN 'weird_location'
            END AS reason
  FROM rules)
""".format(LEAK=O.q(O.re2_any(P.LLM_LEAK_PATTERNS)))


@register("rule_hits", O.with_fixture(_RULES_SQL) + """
SELECT dataset_id, author_id, CAST(garbled_name AS BIGINT) AS garbled_name,
  CAST(llm_leak AS BIGINT) AS llm_leak, CAST(url_typo AS BIGINT) AS url_typo,
  CAST(weird_location AS BIGINT) AS weird_location
FROM rreason""")
def q_rule_hits(spark, sf):
    r = rule_ops.rule_hits(fx.accounts(spark, sf), fx.posts(spark, sf))
    return shape(r.select(*KEYS, *P.RULE_REASONS))


@register("rule_priority", O.with_fixture(_RULES_SQL) + """
SELECT dataset_id, coalesce(reason, 'none') AS reason, count(*) AS n_accounts
FROM rreason GROUP BY ALL""")
def q_rule_priority(spark, sf):
    r = rule_ops.rule_hits(fx.accounts(spark, sf), fx.posts(spark, sf))
    return shape(r.groupBy("dataset_id", F.coalesce("reason", F.lit("none")).alias("reason"))
                 .agg(F.count(F.lit(1)).alias("n_accounts")))


# ---------------------------------------------------------------------------
# X: cross-account TF-IDF similarity
# ---------------------------------------------------------------------------

_TFIDF = O.tfidf_cte()


def _tfidf_parts(spark, sf):
    """Accounts with posts, their number per dataset, their posts and the vocabulary; all but the posts kept."""
    posts = fixture_eposts(spark, sf)
    authors = kept(fixture_ekeys(spark, sf).select(*KEYS).distinct())
    sizes = kept(authors.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")))
    return authors, sizes, posts, kept(sim_ops.vocabulary(sim_ops.term_counts(posts), sizes))


@register("tfidf_vocabulary", O.with_fixture(_EP, _TFIDF) + """
SELECT dataset_id, term, CAST(idx AS BIGINT) AS idx, CAST(df AS BIGINT) AS df,
  round(idf, 6) AS idf
FROM xvocab""")
def q_tfidf_vocabulary(spark, sf):
    _, _, _, vocab = _tfidf_parts(spark, sf)
    return shape(vocab.select("dataset_id", "term", "idx", "df", "idf"))


@register("tfidf_weights", O.with_fixture(_EP, _TFIDF) + """
SELECT dataset_id, author_id, count(*) AS n_terms, round(sum(u), 6) AS sum_weight,
  round(max(u), 6) AS max_weight, round(sum(u * u), 6) AS sq_norm
FROM xu GROUP BY ALL""")
def q_tfidf_weights(spark, sf):
    _, _, posts, vocab = _tfidf_parts(spark, sf)
    u = sim_ops.entries(sim_ops.unit_arrays(posts, vocab))
    return shape(u.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_terms"),
                                      F.sum("u").alias("sum_weight"),
                                      F.max("u").alias("max_weight"),
                                      F.sum(F.col("u") * F.col("u")).alias("sq_norm")))


@register("cross_sim_mean", O.with_fixture(_EP, _TFIDF) + """
SELECT dataset_id, author_id, round(cross_user_sim_mean, 6) AS cross_user_sim_mean FROM xsim""")
def q_cross_sim_mean(spark, sf):
    authors, sizes, posts, vocab = _tfidf_parts(spark, sf)
    units = kept(sim_ops.unit_arrays(posts, vocab))
    m = sim_ops.similarity_mean(units, sizes)
    return shape(authors.join(m, KEYS, "left").select(
        *KEYS, F.coalesce("cross_user_sim_mean", F.lit(0.0)).alias("cross_user_sim_mean")))


@register("cross_sim_max", O.with_fixture(_EP, _TFIDF) + """
SELECT dataset_id, author_id, round(cross_user_sim_max, 6) AS cross_user_sim_max FROM xsim""")
def q_cross_sim_max(spark, sf):
    authors, sizes, posts, vocab = _tfidf_parts(spark, sf)
    m = sim_ops.similarity_max(sim_ops.unit_arrays(posts, vocab), sizes)
    return shape(authors.join(m, KEYS, "left").select(
        *KEYS, F.coalesce("cross_user_sim_max", F.lit(0.0)).alias("cross_user_sim_max")))


# ---------------------------------------------------------------------------
# F: assembly, labels
# ---------------------------------------------------------------------------

from acctsig.operators import assemble as asm  # noqa: E402

_PFE_ALL = O.post_features_cte("pf").replace("FROM posts p)", "FROM eposts p)")
_FM_CTES = [_EP, _PFE_ALL, O.rollup_cte(post_ops.POST_NUMERIC, rollup_ops.DISPERSION),
            O.HASHTAGS, O.TEMPORAL, O.style_cte(), O.tokens_cte(), O.RICH, O.topics_cte(),
            O.TOPICF, O.RN, O.jaccard_cte(), O.bigram_cte(), _PROFILE_SQL, O.tfidf_cte()]


def _fm_source(c: str) -> str:
    if c in asm.ROLLUP_COLUMNS:
        return f"r.{c}"
    if c in prof_ops.PROFILE_COLUMNS:
        return f"p.{c}"
    if c in temp_ops.TEMPORAL_COLUMNS:
        return f"t.{c}"
    if c in asm.HASHTAG_COLUMNS:
        return f"h.{c}"
    if c in asm.CROSS_COLUMNS:
        return f"x.{c}"
    if c == "entropy_volume_interaction":
        return "t.hour_entropy * p.tweet_count"
    return {"ttr": "rc.ttr", "hapax_ratio": "rc.hapax_ratio",
            "vocab_richness": "rc.vocab_richness", "avg_word_len": "rc.avg_word_len",
            "long_word_ratio": "rc.long_word_ratio",
            "content_jaccard_mean": "jc.content_jaccard_mean",
            "content_jaccard_std": "jc.content_jaccard_std",
            "unique_first_words": "f.unique_first_words",
            "repeated_phrase_ratio": "bg.repeated_phrase_ratio",
            "topic_diversity": "tp.topic_diversity",
            "tweet_len_uniformity": "u.tweet_len_uniformity"}.get(c, f"s.{c}")


def _fm_select() -> str:
    out = []
    for c in asm.FEATURE_COLUMNS:
        d = "-10000.0" if c == "vocab_richness" else "0"
        e = f"CAST(coalesce({_fm_source(c)}, {d}) AS DOUBLE)"
        out.append(f"{e} AS {c}" if c in UNROUNDED else f"round({e}, 6) AS {c}")
    return ",\n  ".join(out)


def _on(a: str) -> str:
    return f"{a}.dataset_id = p.dataset_id AND {a}.author_id = p.id"


FEATURE_MATRIX_SQL = O.with_fixture(*_FM_CTES) + f"""
SELECT p.dataset_id, p.id AS author_id,
  {_fm_select()},
  CAST(CASE WHEN l.author_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS label
FROM prof p
LEFT JOIN rollf r ON {_on('r')} LEFT JOIN temporal t ON {_on('t')}
LEFT JOIN sratio s ON {_on('s')} LEFT JOIN suni u ON {_on('u')}
LEFT JOIN sfirst f ON {_on('f')} LEFT JOIN richf rc ON {_on('rc')}
LEFT JOIN topicf tp ON {_on('tp')} LEFT JOIN jacf jc ON {_on('jc')}
LEFT JOIN bigf bg ON {_on('bg')} LEFT JOIN htagf h ON {_on('h')}
LEFT JOIN xsim x ON {_on('x')} LEFT JOIN labels_fx l ON {_on('l')}
"""


def fixture_feature_matrix(spark: SparkSession, sf: str, reuse_mode: str | None = "persist",
                           with_rules: bool = False) -> DataFrame:
    return asm.feature_matrix(spark, fx.accounts(spark, sf), fx.post_keys(spark, sf),
                              fx.labels(spark, sf), reuse_mode=reuse_mode,
                              with_rules=with_rules, texts=lambda keyed: fx.with_text(spark, sf, keyed))


@register("feature_matrix", FEATURE_MATRIX_SQL)
def q_feature_matrix(spark, sf):
    fm = fixture_feature_matrix(spark, sf)
    return shape(fm.select(*KEYS, *asm.FEATURE_COLUMNS, "label"))


@register("label_join", O.with_fixture(_EP) + """
SELECT e.dataset_id, e.author_id,
  CAST(CASE WHEN l.author_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS label
FROM (SELECT DISTINCT dataset_id, author_id FROM eposts) e
LEFT JOIN labels_fx l USING (dataset_id, author_id)""")
def q_label_join(spark, sf):
    e = fixture_eposts(spark, sf).select(*KEYS).distinct()
    return shape(asm.attach_labels(e, fx.labels(spark, sf)))


# ---------------------------------------------------------------------------
# Deterministic scoring chain
#
# A deterministic three-component score per account (shares of posts with a
# link, a '#', an '@') stands in for the three learners' probabilities, so
# the blend, sweep, threshold, confusion, histogram and detection operators
# are compared with SQL exactly. The learners themselves are below.
# ---------------------------------------------------------------------------

from acctsig.operators import evaluate as ev_ops  # noqa: E402
from acctsig.operators import learn as ml_ops  # noqa: E402

_THR = ev_ops.sweep_thresholds()
_THR_SQL = ", ".join(f"({i}, CAST('{t!r}' AS DOUBLE))" for i, t in enumerate(_THR))
_WA, _WB, _WC = P.BLEND_WEIGHTS

_SCORE_SQL = f"""
hcomp AS (
  SELECT dataset_id, author_id, max(lang) AS lang,
    avg(CASE WHEN contains(coalesce(text, ''), 'http') OR contains(coalesce(text, ''), 't.co')
             THEN 1 ELSE 0 END) AS p_a,
    avg(CASE WHEN contains(coalesce(text, ''), '#') THEN 1 ELSE 0 END) AS p_b,
    avg(CASE WHEN contains(coalesce(text, ''), '@') THEN 1 ELSE 0 END) AS p_c
  FROM eposts GROUP BY ALL),
hscore AS (
  SELECT h.*, CASE WHEN l.author_id IS NULL THEN 0 ELSE 1 END AS label,
    {_WA!r} * p_a + {_WB!r} * p_b + {_WC!r} * p_c AS probability
  FROM hcomp h LEFT JOIN labels_fx l USING (dataset_id, author_id)),
thr(idx, threshold) AS (VALUES {_THR_SQL}),
sweep AS (
  SELECT h.lang, t.idx, t.threshold,
    CAST(count_if(h.probability >= t.threshold AND h.label = 1) AS BIGINT) AS tp,
    CAST(count_if(h.probability < t.threshold AND h.label = 1) AS BIGINT) AS fn,
    CAST(count_if(h.probability >= t.threshold AND h.label = 0) AS BIGINT) AS fp,
    CAST(count_if(h.probability < t.threshold AND h.label = 0) AS BIGINT) AS tn
  FROM hscore h JOIN thr t ON TRUE GROUP BY ALL),
best AS (
  SELECT * FROM (SELECT *, 4 * tp - fn - 2 * fp AS score,
                        row_number() OVER (PARTITION BY lang ORDER BY 4 * tp - fn - 2 * fp DESC,
                                           idx ASC) AS r FROM sweep) WHERE r = 1),
hpred AS (
  SELECT h.*, CASE WHEN h.probability >= b.threshold THEN 1 ELSE 0 END AS prediction
  FROM hscore h JOIN best b USING (lang))
"""


def fixture_scores(spark: SparkSession, sf: str) -> DataFrame:
    ep = fixture_eposts(spark, sf)
    t = F.coalesce(F.col("text"), F.lit(""))
    comp = ep.groupBy(*KEYS).agg(
        F.max("lang").alias("lang"),
        F.avg((t.contains("http") | t.contains("t.co")).cast("int")).alias("p_a"),
        F.avg(t.contains("#").cast("int")).alias("p_b"),
        F.avg(t.contains("@").cast("int")).alias("p_c"))
    lab = asm.attach_labels(comp, fx.labels(spark, sf))
    return lab.withColumn("probability",
                          ml_ops.blend_columns([F.col("p_a"), F.col("p_b"), F.col("p_c")]))


def fixture_predictions(spark: SparkSession, sf: str) -> DataFrame:
    s = fixture_scores(spark, sf)
    best = ev_ops.best_threshold(ev_ops.threshold_sweep(s, by=["lang"]), by=["lang"])
    return (s.join(best.select("lang", "threshold"), "lang")
            .withColumn("prediction", (F.col("probability") >= F.col("threshold")).cast("int")))


_EVAL = O.with_fixture(_EP, _SCORE_SQL)


@register("stratified_folds", O.with_fixture(_EP, _SCORE_SQL) + """
SELECT dataset_id, author_id, lang, CAST(label AS BIGINT) AS label,
  CAST((row_number() OVER (PARTITION BY lang, label
        ORDER BY md5(concat_ws('|', '42', CAST(dataset_id AS VARCHAR), CAST(author_id AS VARCHAR))),
                 dataset_id, author_id) - 1) % 5 AS BIGINT) AS fold
FROM hscore""")
def q_stratified_folds(spark, sf):
    s = fixture_scores(spark, sf)
    f = ml_ops.stratified_folds(s, 5, 42, by=["lang"])
    return shape(f.select(*KEYS, "lang", "label", "fold"))


@register("class_weight", _EVAL + """
SELECT lang, CAST(count_if(label = 1) AS BIGINT) AS positives, CAST(count_if(label = 0) AS BIGINT) AS negatives,
  round(CAST(count_if(label = 0) AS BIGINT) / greatest(CAST(count_if(label = 1) AS BIGINT), 1), 6) AS pos_weight
FROM hscore GROUP BY ALL""")
def q_class_weight(spark, sf):
    return shape(ml_ops.class_weights(fixture_scores(spark, sf), by=["lang"]))


@register("blend", _EVAL + """
SELECT dataset_id, author_id, round(probability, 6) AS probability FROM hscore""")
def q_blend(spark, sf):
    return shape(fixture_scores(spark, sf).select(*KEYS, "probability"))


@register("threshold_sweep", _EVAL + """
SELECT lang, CAST(idx AS BIGINT) AS idx, round(threshold, 6) AS threshold,
  CAST(4 * tp - fn - 2 * fp AS BIGINT) AS score, tp, fn, fp, tn
FROM sweep""")
def q_threshold_sweep(spark, sf):
    return shape(ev_ops.threshold_sweep(fixture_scores(spark, sf), by=["lang"]))


@register("best_threshold", _EVAL + """
SELECT lang, CAST(idx AS BIGINT) AS idx, round(threshold, 6) AS threshold,
  CAST(score AS BIGINT) AS score FROM best""")
def q_best_threshold(spark, sf):
    b = ev_ops.best_threshold(ev_ops.threshold_sweep(fixture_scores(spark, sf), by=["lang"]),
                              by=["lang"])
    return shape(b.select("lang", "idx", "threshold", "score"))


@register("confusion_score", _EVAL + """
SELECT lang, CAST(count_if(prediction = 1 AND label = 1) AS BIGINT) AS tp,
  CAST(count_if(prediction = 0 AND label = 1) AS BIGINT) AS fn, CAST(count_if(prediction = 1 AND label = 0) AS BIGINT) AS fp,
  CAST(count_if(prediction = 0 AND label = 0) AS BIGINT) AS tn,
  CAST(4 * CAST(count_if(prediction = 1 AND label = 1) AS BIGINT) - CAST(count_if(prediction = 0 AND label = 1) AS BIGINT)
       - 2 * CAST(count_if(prediction = 1 AND label = 0) AS BIGINT) AS BIGINT) AS score,
  round(CAST(count_if(prediction = 1 AND label = 1) AS BIGINT)
        / greatest(CAST(count_if(prediction = 1) AS BIGINT), 1), 6) AS precision,
  round(CAST(count_if(prediction = 1 AND label = 1) AS BIGINT) / greatest(CAST(count_if(label = 1) AS BIGINT), 1), 6) AS recall,
  round(CAST(count_if(prediction = label) AS BIGINT) / greatest(count(*), 1), 6) AS accuracy,
  CAST(4 * CAST(count_if(label = 1) AS BIGINT) AS BIGINT) AS max_score,
  round((4 * CAST(count_if(prediction = 1 AND label = 1) AS BIGINT) - CAST(count_if(prediction = 0 AND label = 1) AS BIGINT)
        - 2 * CAST(count_if(prediction = 1 AND label = 0) AS BIGINT)) / (4 * greatest(CAST(count_if(label = 1) AS BIGINT), 1)), 6)
    AS share_of_max
FROM hpred GROUP BY ALL""")
def q_confusion_score(spark, sf):
    c = ev_ops.confusion(fixture_predictions(spark, sf), by=["lang"])
    return shape(c.withColumn("share_of_max",
                              ev_ops.share_of_max(F.col("score"), F.col("tp") + F.col("fn"))))


@register("score_histogram", _EVAL.rstrip() + """
, st AS (SELECT lang, label, count(*) AS n,
               CASE WHEN min(probability) = max(probability) THEN min(probability) - 0.5
                    ELSE min(probability) END AS lo,
               CASE WHEN min(probability) = max(probability) THEN max(probability) + 0.5
                    ELSE max(probability) END AS hi
        FROM hscore GROUP BY ALL),
edges AS (SELECT st.*, i AS bin, lo + i * ((hi - lo) / 30) AS e0,
                 CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30) END AS e1
          FROM st, range(30) r(i))
SELECT e.lang, CAST(e.label AS BIGINT) AS label, CAST(e.bin AS BIGINT) AS bin,
  CAST(count(h.probability) AS BIGINT) AS count, round(any_value(e.e0), 6) AS bin_lo,
  round(count(h.probability) / (any_value(e.n) * ((any_value(e.hi) - any_value(e.lo)) / 30)), 6) AS density
FROM edges e LEFT JOIN hscore h
  ON h.lang = e.lang AND h.label = e.label AND h.probability >= e.e0
 AND (h.probability < e.e1 OR (e.bin = 29 AND h.probability <= e.e1))
GROUP BY e.lang, e.label, e.bin""")
def q_score_histogram(spark, sf):
    h = ev_ops.score_histogram(fixture_scores(spark, sf), by=["lang"])
    return shape(h)


@register("detection_union", O.with_fixture(_EP, _SCORE_SQL, _RULES_SQL) + """
SELECT coalesce(r.dataset_id, m.dataset_id) AS dataset_id,
  coalesce(r.author_id, m.author_id) AS author_id,
  CAST(r.author_id IS NOT NULL AS BIGINT) AS rule_hit,
  CAST(m.author_id IS NOT NULL AS BIGINT) AS model_hit
FROM (SELECT dataset_id, author_id FROM rreason WHERE reason IS NOT NULL) r
FULL OUTER JOIN (SELECT dataset_id, author_id FROM hpred WHERE prediction = 1) m
  ON r.dataset_id = m.dataset_id AND r.author_id = m.author_id""")
def q_detection_union(spark, sf):
    rules = rule_ops.rule_hits(fx.accounts(spark, sf), fx.posts(spark, sf))
    return shape(rule_ops.detection_union(rules, fixture_predictions(spark, sf)))


@register("detection_summary", O.with_fixture(_EP, _SCORE_SQL, _RULES_SQL).rstrip() + """
, det AS (
  SELECT coalesce(r.dataset_id, m.dataset_id) AS dataset_id,
         coalesce(r.author_id, m.author_id) AS author_id,
         r.author_id IS NOT NULL AS rule_hit, m.author_id IS NOT NULL AS model_hit
  FROM (SELECT dataset_id, author_id FROM rreason WHERE reason IS NOT NULL) r
  FULL OUTER JOIN (SELECT dataset_id, author_id FROM hpred WHERE prediction = 1) m
    ON r.dataset_id = m.dataset_id AND r.author_id = m.author_id)
SELECT a.dataset_id, a.users AS accounts, coalesce(d.automated, 0) AS automated,
  a.users - coalesce(d.automated, 0) AS human,
  coalesce(d.model_hits, 0) AS model_hits, coalesce(d.rule_hits, 0) AS rule_hits,
  coalesce(d.rule_only, 0) AS rule_only
FROM (SELECT dataset_id, count(*) AS users FROM accounts GROUP BY ALL) a
LEFT JOIN (SELECT dataset_id, count(*) AS automated, CAST(count_if(model_hit) AS BIGINT) AS model_hits,
                  CAST(count_if(rule_hit) AS BIGINT) AS rule_hits, CAST(count_if(rule_hit AND NOT model_hit) AS BIGINT) AS rule_only
           FROM det GROUP BY ALL) d USING (dataset_id)""")
def q_detection_summary(spark, sf):
    acc = fx.accounts(spark, sf)
    rules = rule_ops.rule_hits(acc, fx.posts(spark, sf))
    det = rule_ops.detection_union(rules, fixture_predictions(spark, sf))
    summ = ev_ops.detection_summary(det, acc)
    rs = src.run_summary(acc, det)
    return shape(summ.join(rs.select("dataset_id", "model_hits", "rule_hits", "rule_only"),
                           "dataset_id", "left").na.fill(0))


# ---------------------------------------------------------------------------
# cleaning and vectors; W0: instants and hours from offset strings;
# Detections written as id files and read as a label file
# ---------------------------------------------------------------------------

_DIRTY = ["z", "gap", "inf", "ninf", "nan"]


def _dirty(spark, sf):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf}/customer.parquet").select(k, "c_acctbal")
    num = F.col("c_acctbal").cast("double")
    return c.select(
        k.cast("long").alias("id"), num.alias("z"), F.when(k % 3 != 0, num).alias("gap"),
        F.when(k % 4 == 0, F.lit(float("inf"))).otherwise(num).alias("inf"),
        F.when(k % 5 == 0, F.lit(float("-inf"))).otherwise(num).alias("ninf"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(num).alias("nan"))


_DIRTY_SQL = """
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS DOUBLE) AS b FROM customer),
d AS (SELECT id, round(b, 6) AS z,
             round(CASE WHEN id % 3 = 0 THEN 0.0 ELSE b END, 6) AS gap,
             round(CASE WHEN id % 4 = 0 THEN 0.0 ELSE b END, 6) AS inf,
             round(CASE WHEN id % 5 = 0 THEN 0.0 ELSE b END, 6) AS ninf,
             round(CASE WHEN id % 7 = 0 THEN 0.0 ELSE b END, 6) AS nan FROM c)
"""


@register("clean_features", _DIRTY_SQL + "SELECT * FROM d")
def q_clean_features(spark, sf):
    return shape(asm.clean_features(_dirty(spark, sf), _DIRTY))


@register("feature_vectors", _DIRTY_SQL + """
SELECT id, CAST(5 AS BIGINT) AS size, array_to_string([z, gap, inf, ninf, nan], ' ') AS vector FROM d""")
def q_feature_vectors(spark, sf):
    from pyspark.ml.functions import vector_to_array
    v = asm.vectorize(_dirty(spark, sf), _DIRTY).select("id", vector_to_array("features").alias("v"))
    text = F.array_join(F.transform("v", lambda x: F.round(x, 6).cast("string")), " ")
    return shape(v.select("id", F.size("v").alias("size"), text.alias("vector")))


@register("offset_times", """
WITH e AS (SELECT CAST(event_id AS BIGINT) AS event_id, ts, CAST(event_id % 5 AS INT) AS kind FROM events),
o AS (SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 120 WHEN 2 THEN -570 WHEN 3 THEN 345 ELSE 0 END AS minutes FROM e)
SELECT event_id, CAST(epoch_us(ts) - (CAST(minutes AS BIGINT) * 60000000) AS BIGINT) AS us, CAST(hour(ts) AS BIGINT) AS hour
FROM o""")
def q_offset_times(spark, sf):
    """The wall clock of every event with one of five offsets, as text, parsed as instants and local hours."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    wall = F.regexp_replace(F.col("ts").cast("timestamp_ntz").cast("string"), " ", "T")
    offsets = F.array(*(F.lit(x) for x in ("Z", "+02:00", "-09:30", "+05:45", "")))
    text = F.concat(wall, F.element_at(offsets, (F.col("event_id") % 5 + 1).cast("int")))
    ts, hour = src.parse_created_at(text)
    posts = ev.select(F.col("event_id").cast("long").alias("event_id"), ts.alias("created_at"), hour.alias("hour_local"))
    return shape(temp_ops.post_times(posts, hour="hour_local", keys=("event_id",)))


@register("detection_files", O.with_fixture(_EP, _SCORE_SQL, _RULES_SQL) + """
SELECT coalesce(r.dataset_id, m.dataset_id) AS dataset_id,
  CAST(coalesce(r.author_id, m.author_id) AS VARCHAR) AS author_id
FROM (SELECT dataset_id, author_id FROM rreason WHERE reason IS NOT NULL) r
FULL OUTER JOIN (SELECT dataset_id, author_id FROM hpred WHERE prediction = 1) m
  ON r.dataset_id = m.dataset_id AND r.author_id = m.author_id""")
def q_detection_files(spark, sf):
    """Detections written as id files per dataset and read again as label files."""
    import uuid
    from acctsig.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/detections-{uuid.uuid4().hex}"
    rules = rule_ops.rule_hits(fx.accounts(spark, sf), fx.posts(spark, sf))
    job_ops.write_detections(rule_ops.detection_union(rules, fixture_predictions(spark, sf)), path)
    found = [d for d in sorted(P.PRACTICE_LANG) if src.exists(spark, f"{path}/dataset_id={d}")]
    return shape(src.union_all([src.read_labels(spark, f"{path}/dataset_id={d}", d) for d in found]))


@register("cross_report", _EVAL.rstrip() + """
, tuned AS (SELECT * FROM best),
rep AS (
  SELECT h.lang, k.kind AS threshold_kind,
    CASE k.kind WHEN 'test_tuned' THEN b.threshold ELSE 0.5 END AS threshold, h.label, h.probability
  FROM hscore h JOIN tuned b USING (lang), (VALUES ('test_tuned'), ('given')) k(kind)),
c AS (
  SELECT lang, threshold_kind, any_value(threshold) AS threshold,
    CAST(count_if(probability >= threshold AND label = 1) AS BIGINT) AS tp,
    CAST(count_if(probability < threshold AND label = 1) AS BIGINT) AS fn,
    CAST(count_if(probability >= threshold AND label = 0) AS BIGINT) AS fp,
    CAST(count_if(probability < threshold AND label = 0) AS BIGINT) AS tn
  FROM rep GROUP BY lang, threshold_kind)
SELECT lang, threshold_kind,
  round(threshold, 6) AS threshold, CAST(4 * tp - fn - 2 * fp AS BIGINT) AS score,
  CAST(4 * (tp + fn) AS BIGINT) AS max_score, tp, fn, fp, tn,
  round((tp + tn) / greatest(tp + fn + fp + tn, 1), 6) AS accuracy,
  round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall
FROM c""")
def q_cross_report(spark, sf):
    """The arithmetic of E4's report per language: the stand-in score at the threshold tuned on its labels and at 0.5.

    ``cross_dataset_report`` trains.
    """
    scored = kept(fixture_scores(spark, sf))
    langs = [r["lang"] for r in scored.select("lang").distinct().orderBy("lang").collect()]
    parts = [ml_ops.cross_report(spark, scored.where(F.col("lang") == lg), 0.5, None, None, lg) for lg in langs]
    return shape(src.union_all(parts).drop("train_ds", "test_ds")
                 .withColumn("threshold_kind", F.regexp_replace("threshold_kind", "train_oof", "given")))


# ---------------------------------------------------------------------------
# A1-A4, W2-W4 from mergeable state: posts arrive in three parts
# ---------------------------------------------------------------------------

from acctsig.operators import state as state_ops  # noqa: E402


def arrived_state(spark: SparkSession, sf: str, keyed: DataFrame) -> DataFrame:
    """The state of the posts with these keys, written in three arrivals and merged.

    An arrival's posts are told by their keys, which are kept for all arrivals. Their signals, without texts,
    are kept until the arrival is written, as its two aggregations both read them.
    """
    import uuid
    from acctsig.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    keyed = asm.reuse(keyed, "persist")
    for part in range(3):
        mine = keyed.where(F.pmod(F.xxhash64("author_id", "post_seq"), F.lit(3)) == part)
        feats = kept(post_ops.post_features(fx.with_text(spark, sf, mine)).drop("text", "lang"))
        state_ops.arrive(state_ops.daily_state(feats), path)
        feats.unpersist()
    keyed.unpersist()
    return state_ops.merged(spark.read.parquet(path))


@register("state_rollup", ORACLES["author_post_rollup"])
def q_state_rollup(spark, sf):
    r = state_ops.rollup(arrived_state(spark, sf, fx.post_keys(spark, sf)))
    return shape(r.select(*KEYS, "n_posts", *(f"{k}_{x}" for k in post_ops.POST_NUMERIC for x in ("mean", "sum"))))


@register("state_dispersion", ORACLES["author_len_dispersion"])
def q_state_dispersion(spark, sf):
    r = state_ops.rollup(arrived_state(spark, sf, fx.post_keys(spark, sf)))
    return shape(r.select(*KEYS, *(f"{k}_{x}" for k in rollup_ops.DISPERSION for x in ("std", "max"))))


@register("state_hours", ORACLES["temporal_hours"])
def q_state_hours(spark, sf):
    h = state_ops.hours(arrived_state(spark, sf, fixture_ekeys(spark, sf)))
    return shape(h.select(*KEYS, "hour_entropy", "night_ratio", "active_hours"))


# ---------------------------------------------------------------------------
# The ensemble itself, at the original length. Its
# queries share one training per language in a session.
# ---------------------------------------------------------------------------

_MATRICES: dict[tuple[str, str], DataFrame] = {}
_TRAINED: dict[tuple[str, str], tuple] = {}


def language_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The feature matrix with languages, in the checkpoint folder."""
    key = spark.sparkContext.applicationId, sf
    if key not in _MATRICES:
        from acctsig.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        _MATRICES[key] = job_ops.features_with_lang(spark, fx.accounts(spark, sf), fx.post_keys(spark, sf), fx.labels(spark, sf),
                                                    texts=lambda keyed: fx.with_text(spark, sf, keyed)).checkpoint(eager=True)
    return _MATRICES[key]


def trained(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """The feature matrix with languages, and each language's ensemble and out-of-fold scores."""
    key = spark.sparkContext.applicationId, sf
    if key not in _TRAINED:
        fm = language_matrix(spark, sf)
        _TRAINED[key] = fm, job_ops.train_by_language(spark, fm)
    return _TRAINED[key]


@register("ensemble_oof", O.with_fixture(_EP, _SCORE_SQL).rstrip() + """
, folded AS (
  SELECT lang, label, (row_number() OVER (PARTITION BY lang, label
         ORDER BY md5(concat_ws('|', '42', CAST(dataset_id AS VARCHAR), CAST(author_id AS VARCHAR))), dataset_id, author_id) - 1) % 5 AS fold
  FROM hscore)
SELECT lang, CAST(fold AS BIGINT) AS fold, CAST(label AS BIGINT) AS label, count(*) AS accounts, count(*) AS scored,
  CAST(count(*) FILTER (label = 1) AS BIGINT) AS positives
FROM folded GROUP BY ALL""")
def q_ensemble_oof(spark, sf):
    """M6: accounts per language, fold and label, and how many of them have an out-of-fold probability."""
    parts = [o.withColumn("lang", F.lit(lg)) for lg, (_, o) in trained(spark, sf)[1].items()]
    return shape(src.union_all(parts).groupBy("lang", "fold", "label").agg(
        F.count("*").alias("accounts"), F.count_if(F.col("probability").between(0.0, 1.0)).alias("scored"),
        F.count_if(F.col("label") == 1).alias("positives")))


@register("ensemble_threshold", _EVAL + """
SELECT lang, count(*) AS accounts, CAST(count_if(label = 1) AS BIGINT) AS positives, CAST(4 * count_if(label = 1) AS BIGINT) AS max_score,
  CAST(1 AS BIGINT) AS adds_up, CAST(1 AS BIGINT) AS on_grid, CAST(1 AS BIGINT) AS first_best
FROM hscore GROUP BY lang""")
def q_ensemble_threshold(spark, sf):
    """M8: the learned threshold is the first of the sweep with the best out-of-fold score, and its report adds up."""
    parts = []
    for lg, (ens, oof) in trained(spark, sf)[1].items():
        best = ev_ops.threshold_sweep(oof).orderBy(F.desc("score"), "threshold").first()
        parts.append(ml_ops.training_report(ens, oof).select(
            "lang", (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("accounts"), (F.col("tp") + F.col("fn")).alias("positives"),
            "max_score", (F.col("score") == 4 * F.col("tp") - F.col("fn") - 2 * F.col("fp")).alias("adds_up"),
            F.lit(ens.threshold in ev_ops.sweep_thresholds()).alias("on_grid"),
            ((F.col("threshold") == best["threshold"]) & (F.col("score") == best["score"])).alias("first_best")))
    return shape(src.union_all(parts))


@register("ensemble_reloaded", O.with_fixture(_EP, _SCORE_SQL) + """
SELECT lang, count(*) AS accounts, CAST(0 AS BIGINT) AS differ FROM hscore GROUP BY lang""")
def q_ensemble_reloaded(spark, sf):
    """Ensembles saved and loaded again score every account alike."""
    import uuid
    from acctsig.session import ensure_checkpoint_dir
    fm, models = trained(spark, sf)
    path, parts = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}", []
    for lg, (ens, _) in models.items():
        ml_ops.save(ens, path, spark)
        rows = asm.vectorize(fm.where(F.col("lang") == lg))
        both = ml_ops.blend(job_ops.load_models(spark, path)[lg], ml_ops.blend(ens, rows, "kept"), "loaded")
        parts.append(both.select("lang", "kept", "loaded"))
    return shape(src.union_all(parts).groupBy("lang").agg(
        F.count("*").alias("accounts"), F.count_if(F.col("kept") != F.col("loaded")).alias("differ")))


@register("duplicate_accounts", """
SELECT CAST(30 + o_custkey % 4 AS BIGINT) AS dataset_id, CAST(o_custkey AS BIGINT) AS id, CAST(max(o_orderkey) AS BIGINT) AS pos,
  round(CAST(arg_max(o_totalprice, o_orderkey) AS DOUBLE), 6) AS price
FROM orders GROUP BY o_custkey""")
def q_duplicate_accounts(spark, sf):
    """Of the rows that share an account id (here a customer's orders) the last one stays."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    rows = o.select((F.lit(30) + F.col("o_custkey") % 4).alias("dataset_id"), F.col("o_custkey").alias("id"),
                    F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("double").alias("price"))
    return shape(src.dedupe_accounts(rows))


@register("routed_languages", """
SELECT lang, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en' END AS model_lang, count(*) AS documents
FROM documents GROUP BY ALL""")
def q_routed_languages(spark, sf):
    """The language whose model scores each document's language."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return shape(d.select("lang", src.route_language(F.col("lang"), ["en", "fr"]).alias("model_lang"))
                 .groupBy("lang", "model_lang").agg(F.count("*").alias("documents")))


@register("ensemble_predict")
def q_ensemble_predict(spark, sf):
    """M9: probability and prediction of every account by the ensemble of its language."""
    fm, models = trained(spark, sf)
    parts = [ml_ops.predict(e, asm.vectorize(fm.where(F.col("lang") == lg))) for lg, (e, _) in models.items()]
    return shape(src.union_all([p.select(*KEYS, "lang", "probability", "prediction") for p in parts]))


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Each language's 20 features with the most splits; the first 15 are those of the chart."""
    parts = [ml_ops.feature_importance(spark, e) for e, _ in trained(spark, sf)[1].values()]
    return shape(src.union_all(parts).withColumn("charted", F.col("rank") <= P.TOP_FEATURES_PLOT))


@register("cross_dataset_report")
def q_cross_dataset_report(spark, sf):
    """Trained on one dataset, tested on another, for the four original pairs."""
    fm = language_matrix(spark, sf)  # the pairs' ensembles are trained here, those of the languages are not asked for
    return shape(job_ops.cross_dataset_report(spark, fm, job_ops.cross_pairs(fm)))


from acctsig.plans import job as job_ops  # noqa: E402
