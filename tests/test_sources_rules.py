"""Sources (JSON documents, label files), keys, profile and rule edges."""

import json

from pyspark.sql import functions as F

from acctsig.operators import profile as prof
from acctsig.operators import rules as rule_ops
from acctsig.sources import tables as src


def test_json_document_and_labels(spark, tmp_path):
    doc = {"users": [
        {"id": "u1", "name": "Ada\x01", "location": "x"},
        {"id": "u2", "name": "Bob", "location": "TOKYO: JP", "tweet_count": 7},
        {"id": "u1", "name": "Ada Lovelace", "location": None},
        {"id": "u3", "name": "No Posts", "location": ":null:"}],
        "posts": [
            {"author_id": "u1", "text": "AS AN AI I think", "created_at": "2024-01-01T23:05:00+02:00"},
            {"author_id": "u2", "text": "see htts://x", "created_at": "2024-01-01T10:00:00Z"},
            {"author_id": "ghost", "text": "hi", "created_at": "2024-01-01T10:00:00Z"}]}
    p = tmp_path / "dataset.posts&users.77.json"
    p.write_text(json.dumps(doc, indent=2))
    acc, posts = src.read_dataset_json(spark, str(p), 77)
    a = {r["id"]: r for r in acc.collect()}
    assert a["u1"]["name"] == "Ada Lovelace"              # later duplicate wins
    assert {r["lang"] for r in acc.collect()} == {"en"}   # missing lang -> en
    ps = {r["author_id"]: r for r in posts.collect()}
    assert ps["u1"]["hour_local"] == 23                   # own offset, not UTC
    ep = src.eligible_posts(posts, acc)
    assert {r["author_id"] for r in ep.collect()} == {"u1", "u2"}
    ea = src.eligible_accounts(acc, posts)
    assert {r["id"] for r in ea.collect()} == {"u1", "u2"}
    rules = {r["author_id"]: r for r in rule_ops.rule_hits(acc, posts).collect()}
    assert set(rules) == {"u1", "u2"}                     # rule only for accounts with posts
    assert rules["u1"]["reason"] == "llm_leak"            # upper-case leak is lower-cased
    assert rules["u2"]["reason"] == "url_typo"            # R3 before R4 ('O:' in TOKYO: JP)
    assert rules["u2"]["weird_location"]
    lab = tmp_path / "dataset.bots.77.txt"
    lab.write_text("  u1  \n\n u2\nu1\n   \n")
    assert sorted((r["dataset_id"], r["author_id"]) for r in src.read_labels(spark, str(lab)).collect()) \
        == [(77, "u1"), (77, "u2")]


def test_created_at_forms(spark):
    rows = [("2024-01-01T23:05:00+02:00", 23, 1704143100), ("2024-01-01 23:05:00Z", 23, 1704150300),
            ("2024-01-01T23:05:00", 23, 1704150300), ("2024-01-01", 0, 1704067200), (None, None, None)]
    df = spark.createDataFrame([(s,) for s, *_ in rows], "s string")
    ts, hour = src.parse_created_at(F.col("s"))
    got = {r["s"]: (r["h"], r["u"]) for r in df.select("s", hour.alias("h"), F.unix_seconds(ts).alias("u")).collect()}
    assert got == {s: (h, u) for s, h, u in rows}


def test_profile_edges(spark):
    rows = [(1, None, None, None, None, None, None),
            (2, "Ada Byron", "ab_cd12\n", "a | b | c", "Paris", 5, 1.5),
            (3, "ab\x7f", "User1", "see http://x\nmore", "  ", None, None),
            (4, "  John Smith ", "x_y", "#tag 🤖", "Rome", 0, None)]
    df = spark.createDataFrame(rows, "id long, name string, username string, description string, "
                                     "location string, tweet_count long, z_score double") \
        .withColumn("dataset_id", F.lit(30)).withColumn("n", F.lit(9))
    out = {r["id"]: r for r in prof.profile_features(df, F.col("n")).collect()}
    assert out[1]["tweet_count"] == 9 and out[1]["z_score"] == 0.0
    assert out[1]["has_description"] == 0 and out[3]["has_location"] == 0
    assert out[2]["desc_pipe_count"] == 2 and out[2]["desc_formulaic"] == 1
    assert out[2]["username_bot_pattern"] == 1            # trailing newline allowed by $
    assert out[2]["name_generic_pattern"] == 1 and out[4]["name_generic_pattern"] == 1
    assert out[3]["name_has_special_chars"] == 1          # DEL is not a word/space char
    assert out[3]["profile_has_url"] == 1 and out[3]["desc_has_newline"] == 1
    assert out[4]["profile_has_emoji"] == 1 and out[4]["profile_has_hashtag"] == 1
    assert out[2]["username_digit_ratio"] == 2 / 8


def test_language_routing(spark):
    df = spark.createDataFrame([("en",), ("fr",), ("de",), (None,)], "lang string")
    got = [r["m"] for r in df.select(src.route_language(F.col("lang"), ["en", "fr"]).alias("m"))
           .collect()]
    assert got == ["en", "fr", "en", "en"]
