"""Mergeable account state against one aggregation over all posts."""

import random

from pyspark.sql import functions as F

from acctsig.operators import post as post_ops
from acctsig.operators import rollup as roll
from acctsig.operators import state
from acctsig.operators import temporal as temp

KEYS = ["dataset_id", "author_id"]


def posts(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        a = "hot" if i % 3 == 0 else f"a{rng.randrange(9)}"
        text = rng.choice([None, "", "x " * rng.randint(1, 90) + f"#t{rng.randrange(40)} #same", "see http://x.y @z WOW!"])
        rows.append((1, a, i, text, "en", f"2024-03-{rng.randint(1, 6):02} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00"))
    return (spark.createDataFrame(rows, "dataset_id long, author_id string, post_seq long, text string, lang string, at string")
            .withColumn("created_at", F.col("at").cast("timestamp")).drop("at"))


def rows(df, digits=9):
    return {r.author_id: [round(v, digits) if isinstance(v, float) else v for v in r] for r in df.collect()}


def test_merged_days_equal_one_aggregation(spark, tmp_path):
    feats = post_ops.post_features(posts(spark)).cache()
    path = str(tmp_path / "state")
    for part in range(4):
        state.arrive(state.daily_state(feats.where(F.col("post_seq") % 4 == part)), path)
    state.compacted(spark, path, str(tmp_path / "compact"))
    for stored in (path, str(tmp_path / "compact")):
        m = state.merged(spark.read.parquet(stored)).cache()
        want = roll.account_rollup(feats)
        assert rows(state.rollup(m).select(want.columns)) == rows(want)
        hours = temp.hour_profile(temp.post_times(feats))
        assert rows(state.hours(m).select(hours.columns)) == rows(hours)
        exact, near = rows(roll.hashtag_stats(feats)), rows(state.hashtags(m))
        for a, e in exact.items():
            assert near[a][2] == e[2] and near[a][5:] == e[5:]
            assert abs(near[a][3] - e[3]) <= max(1, 0.08 * e[3])  # five standard errors
        m.unpersist()
    feats.unpersist()


def test_empty_and_equal_posts(spark):
    feats = post_ops.post_features(posts(spark, 30))
    assert state.merged(state.daily_state(feats.limit(0))).count() == 0
    twice = state.merged(state.daily_state(feats).unionByName(state.daily_state(feats)))
    once = {r.author_id: r for r in state.merged(state.daily_state(feats)).collect()}
    for r in twice.collect():
        assert r.n_posts == 2 * once[r.author_id].n_posts and r.char_len_max == once[r.author_id].char_len_max
