"""Feature operators on small literal tables with answers worked out by hand."""

import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctsig.operators import lexical as lex
from acctsig.operators import post as post_ops
from acctsig.operators import similarity as sim
from acctsig.operators import temporal as temp

SCHEMA = "dataset_id long, author_id string, post_seq long, created_at timestamp_ntz, lang string, text string"
DAY = datetime(2024, 1, 1)


def posts(spark, rows):
    """(author, text) pairs in file order, one hour apart."""
    return spark.createDataFrame([(30, a, i, DAY + timedelta(hours=i), "en", t)
                                  for i, (a, t) in enumerate(rows)], SCHEMA).repartition(3)


POSTS = [
    # text, lang, signals other than zero, hashtags
    ("Click https://t.co/x DM @bob #Love #\u00c9t\u00e9!", "en",
     dict(url_count=1, hashtag_count=2, mention_count=1, char_len=40, word_count=6, caps_ratio=5 / 26, excl_count=1,
          has_bait=1, has_generic_hashtag=1, has_url=1, has_hashtag=1, has_mention=1), ["#love", "#\u00e9t\u00e9"]),
    ("wait... what?? \U0001F916\n\nNO....", "en",
     dict(emoji_count=1, char_len=24, word_count=4, caps_ratio=2 / 10, quest_count=2, ellipsis_count=2, newline_count=2), []),
    ("  \t ", "en", dict(char_len=4), []),
    (None, "en", {}, []),
    ("gratuit", "fr", dict(char_len=7, word_count=1, has_bait=1), []),
    ("gratuit", "en", dict(char_len=7, word_count=1), []),
    ("subscribe", "de", dict(char_len=9, word_count=1), []),
]


def test_post_signals(spark):
    rows = [(30, "a", i, DAY, lang, t) for i, (t, lang, *_) in enumerate(POSTS)]
    got = {r["post_seq"]: r for r in post_ops.post_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (text, _, some, tags) in enumerate(POSTS):
        assert list(got[i]["hashtags"]) == tags
        for name in post_ops.POST_NUMERIC:
            assert got[i][name] == pytest.approx(some.get(name, 0)), (name, text)


# Seconds after midnight of each author's posts, and the features that they give.
CLOCKS = {
    "uneven": ([25140, 25170, 25230, 28830], dict(
        # gaps 30, 60, 3600; hours 6, 6, 7, 8
        inter_tweet_mean=1230, inter_tweet_std=math.sqrt(2808600), inter_tweet_min=30, inter_tweet_max=3600,
        inter_tweet_median=60, inter_tweet_cv=math.sqrt(2808600) / 1230, posts_per_hour=4 / 1.025, hour_entropy=1.5,
        night_ratio=0.5, rapid_fire_ratio=1 / 3, regular_interval_ratio=0, active_hours=3, max_gap_ratio=3600 / 3690,
        posting_span_hours=1.025, temporal_burstiness=(math.sqrt(2808600) - 1230) / (math.sqrt(2808600) + 1230))),
    "hourly, over midnight": ([82800, 86400, 90000], dict(
        inter_tweet_mean=3600, inter_tweet_std=0, inter_tweet_median=3600, hour_entropy=math.log2(3), night_ratio=2 / 3,
        regular_interval_ratio=1, rapid_fire_ratio=0, active_hours=3, temporal_burstiness=-1, max_gap_ratio=0.5)),
    "once": ([500], dict(inter_tweet_mean=0, inter_tweet_median=0, hour_entropy=0, night_ratio=0, active_hours=1,
                         posts_per_hour=0, posting_span_hours=0)),
    "twice at once": ([500, 500], dict(
        # the span counts as one second
        inter_tweet_mean=0, rapid_fire_ratio=1, regular_interval_ratio=0, posts_per_hour=7200, max_gap_ratio=0,
        posting_span_hours=1 / 3600, night_ratio=1, active_hours=1, temporal_burstiness=0)),
    "two days apart": ([0, 59, 172800], dict(
        # gaps 59 and 172741: an even number of gaps has its median between them
        inter_tweet_median=86400, rapid_fire_ratio=0.5, inter_tweet_max=172741, max_gap_ratio=172741 / 172800)),
}


@pytest.mark.parametrize("bucket,median", [(temp.DAY_MICROS, "radix"), (7_000_000, "radix"),
                                           (temp.DAY_MICROS, "aggregate")])
def test_posting_rhythm(spark, bucket, median):
    rows = [(30, a, i, DAY + timedelta(seconds=s), "en", "") for a, (clock, _) in CLOCKS.items()
            for i, s in enumerate(clock[::-1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["author_id"]: r for r in temp.temporal_features(df, bucket_micros=bucket, median=median).collect()}
    for author, (_, features) in CLOCKS.items():
        for name, value in features.items():
            assert got[author][name] == pytest.approx(value, abs=1e-9), (author, name)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        # One hour apart over the spring change of New York (07:00 UTC), as instants and as wall clocks.
        df = spark.sql("SELECT 30L AS dataset_id, 'a' AS author_id, x AS created_at FROM VALUES "
                       "(timestamp'2024-03-10 06:30:00Z'), (timestamp'2024-03-10 07:30:00Z') AS t(x)")
        wall = spark.sql("SELECT 30L AS dataset_id, 'a' AS author_id, x AS created_at FROM VALUES "
                         "(timestamp_ntz'2024-03-10 01:30:00'), (timestamp_ntz'2024-03-10 02:30:00') AS t(x)")
        for t in (df, wall):
            assert temp.temporal_features(t).first()["inter_tweet_mean"] == 3600
        assert sorted(r["hour"] for r in temp.post_times(df).collect()) == [6, 7]
        assert sorted(r["hour"] for r in temp.post_times(wall).collect()) == [1, 2]
        local = df.withColumn("hour_local", F.lit(23))
        assert {r["hour"] for r in temp.post_times(local, hour="hour_local").collect()} == {23}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


LEXICAL = {
    "letters": (["a b c", "A b d", "b c a b"], dict(
        # a 3, b 4, c 2, d 1; pairs of posts share 2 of 4 tokens; bigrams shared: ab, then ab and bc, then ab
        ttr=0.4, hapax_ratio=0.25, vocab_richness=2000, avg_word_len=1, long_word_ratio=0, content_jaccard_mean=0.5,
        content_jaccard_std=0, repeated_phrase_ratio=4 / 3, unique_first_words=2 / 3, tweet_len_uniformity=1,
        char_len_cv=math.sqrt(8 / 9) / (17 / 3), punctuation_diversity=0, just_starter_ratio=0, avg_sentence_completeness=0,
        short_generic_ratio=1, url_consistency=0)),
    "mixed": (["Just extraordinary things lol.", "iPhone and McDonald!", "   ", "just"], dict(
        # five words of letters alone; "just" alone is no starter, as nothing follows it
        ttr=7 / 8, hapax_ratio=6 / 7, long_word_ratio=1 / 6, avg_word_len=(4 + 13 + 6 + 6 + 3 + 4) / 6,
        just_starter_ratio=1 / 4, avg_sentence_completeness=1 / 2, artificial_caps_ratio=1 / 4, unique_first_words=1 / 2,
        punctuation_diversity=2, repeated_phrase_ratio=0, content_jaccard_mean=0)),
    "blank": (["", None, " \n"], dict(
        ttr=0, hapax_ratio=0, vocab_richness=-10000, avg_word_len=0, content_jaccard_mean=0, repeated_phrase_ratio=0,
        unique_first_words=0, topic_diversity=0, tweet_len_uniformity=1 / 3 * 0)),
}


def test_text_diversity(spark):
    df = posts(spark, [(a, t) for a, (texts, _) in LEXICAL.items() for t in texts])
    got = {r["author_id"]: r for r in lex.lexical_features(df, spark).collect()}
    for author, (_, features) in LEXICAL.items():
        for name, value in features.items():
            assert got[author][name] == pytest.approx(value, abs=1e-9), (author, name)


def test_similarity_of_short_documents(spark):
    rows = [("a", "cat dog"), ("a", "cat"), ("b", "dog cat cat"), ("c", "dog emu"), ("d", "x"), ("e", "emu emu")]
    got = {r["author_id"]: r for r in sim.cross_user_similarity(posts(spark, rows), block=2).collect()}
    # Terms of two or more letters in two or more accounts: cat (a 2, b 2), dog (a, b, c), emu (c, e 2).
    # With n = 5: idf of cat and emu 1 + ln 2, of dog 1 + ln 1.5.
    p, q = 1 + math.log(2), 1 + math.log(1.5)
    ab = 1.0
    a = np.array([2 * p, q, 0]) / math.hypot(2 * p, q)
    c = np.array([0, q, p]) / math.hypot(q, p)
    ac, ce = float(a @ c), float(c[2])
    best = {"a": ab, "b": ab, "c": max(ac, ce), "d": 0, "e": ce}
    mean = {"a": (ab + ac) / 5, "b": (ab + ac) / 5, "c": (2 * ac + ce) / 5, "d": 0, "e": ce / 5}
    for x in best:
        assert got[x]["cross_user_sim_max"] == pytest.approx(best[x], abs=1e-12)
        assert got[x]["cross_user_sim_mean"] == pytest.approx(mean[x], abs=1e-12)
    alone = sim.cross_user_similarity(posts(spark, [("a", "one two"), ("a", "two")])).first()
    assert (alone["cross_user_sim_max"], alone["cross_user_sim_mean"]) == (0, 0)


def test_first_posts_uses_group_limit(spark):
    df = spark.createDataFrame([(30, 1, i, "a b") for i in range(100)],
                               "dataset_id long, author_id long, post_seq long, text string")
    plan = lex.first_posts(df, 41)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert lex.first_posts(df, 41).count() == 41


def test_radix_median_exact(spark):
    rnd = random.Random(11)
    rows = []
    for g in range(5):
        n = rnd.randint(1, 300)
        scale = rnd.choice([1, 1000, 10 ** 9, 2 ** 50])
        rows += [(0, g, rnd.randint(0, scale)) for _ in range(n)]
    rows += [(0, 9, 7)] * 40 + [(0, 9, 2 ** 62)]            # heavy duplicates, huge value
    df = spark.createDataFrame(rows, "dataset_id long, author_id long, d long")
    got = {r["author_id"]: r["median"] for r in temp.radix_median(df).collect()}
    assert got == {g: statistics.median(float(r[2]) for r in rows if r[1] == g) for g in {r[1] for r in rows}}


@pytest.mark.parametrize("kind", ["clustered", "uniform", "equal"])
def test_best_similarity_equals_a_dense_product(spark, kind):
    """String ids, blocks of a few accounts, two datasets."""
    import numpy as np
    rng = np.random.default_rng(3)
    want, rows, sizes = {}, [], []
    for ds, n in ((30, 25), (31, 9)):
        x = rng.random((n, 12)) * (rng.random((n, 12)) < 0.5)
        if kind == "clustered":
            x = rng.random((4, 12))[rng.integers(0, 4, n)] + 0.05 * rng.random((n, 12))
        if kind == "equal":
            x = np.tile(rng.random(12), (n, 1))
        x[:, 0] += 0.01  # no empty vector
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, 0)
        sizes.append((ds, n))
        for i in range(n):
            want[ds, f"id-{i}"] = s[i].max()
            rows += [(ds, f"id-{i}", int(t), "t", float(x[i, t])) for t in np.flatnonzero(x[i])]
    units = spark.createDataFrame(rows, "dataset_id long, author_id string, idx int, term string, u double").repartition(4)
    n = spark.createDataFrame(sizes, "dataset_id long, n long")
    for block in (4, 100):
        got = {(r.dataset_id, r.author_id): r.cross_user_sim_max for r in sim.similarity_max(units, n, block=block).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
