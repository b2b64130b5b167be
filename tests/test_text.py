"""Regex translation and literal gating agree with Python ``re``/``str``."""

import re

import pytest
from pyspark.sql import functions as F

from acctsig.functions import patterns as P
from acctsig.functions.text import (alternatives, count_matches, gated_any, java_regex,
                                    required_literals, tokens, word_set_any)

EDGE = [
    "", "free access", "free-content", "freecontent", "free\naccess", "éfree access",
    "free accessé", "free\raccess", "FREE stuff and CONTENT", "DM me", "éDM", "DM",
    "DÉCOUVREZ nos offres", "découvrir", "word split here", "#été #Love",
    "pinterest.com", "a😀b☀c🤖 🔒", "#Lovely day", "check it out", "checkout my",
    "pinned\ttweet", "Pinned: the tweet", "opt-in", "OPT IN", "optin", "join   us",
    "join\nme", "subscribe!", "link in bio", "don't miss", "DON'T MISS", "lien dans",
    "suivez", "suivre", "abonnez-vous", "abonne", "cliquez", "rejoignez", "gratuit",
    "ne manquez pas", "ne  manque pas", "lol", "LOL!", "lolz", "ain't", "bro,", "smh...",
    "I'm here", "im here", "It's nice to see", "Honestly, yes", "honestly yes",
    "loving the vibes", "a dose of", "who else loves", "morning walk", "innovation",
    "as an ai model", "as an airline", "Here are some of my recent tweets:",
    "voici mes récents tweets", "voici les versions révisée", "here are the rewritten",
    "ſubscribe", "KLICK", "Kelvin click", "ab", "x.y", "a...b.....c", "ééé",
]

BOOL_PATTERNS = (P.EN_BAIT_PATTERNS + P.FR_BAIT_PATTERNS + P.GENERIC_HASHTAG_PATTERNS +
                 [P.FORMAL_PATTERN, P.SLANG_PATTERN, P.AI_PHRASE_PATTERN,
                  P.GENERIC_LIFE_PATTERN])


@pytest.fixture(scope="module")
def edge_df(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "i int, t string")
    return df.select("i", "t", F.lower("t").alias("low"),
                     tokens(F.col("t")).alias("tok")).cache()


def test_required_literals_are_necessary():
    for p in BOOL_PATTERNS + P.LLM_LEAK_PATTERNS:
        for a in alternatives(p):
            keys = required_literals(a)
            if not keys:
                continue
            for s in EDGE:
                if re.search(a, s, re.I):
                    folded = s.lower().replace("ſ", "s")
                    assert any(k.lower() in folded for k in keys) or "K" in s, (a, s)


def test_alternatives_preserve_meaning():
    for p in BOOL_PATTERNS:
        alts = alternatives(p)
        for s in EDGE:
            assert bool(re.search(p, s, re.I)) == any(re.search(a, s, re.I) for a in alts), (p, s)


def test_gated_patterns_match_python(edge_df):
    exprs = [gated_any(F.col("t"), F.col("low"), [p], True).alias(f"p{k}")
             for k, p in enumerate(BOOL_PATTERNS)]
    rows = edge_df.select("i", *exprs).orderBy("i").collect()
    for r in rows:
        s = EDGE[r["i"]]
        for k, p in enumerate(BOOL_PATTERNS):
            assert r[f"p{k}"] == bool(re.search(p, s, re.I)), (p, s)


def test_leak_patterns_on_lowercase(edge_df):
    exprs = [gated_any(F.col("low"), F.col("low"), [p]).alias(f"p{k}")
             for k, p in enumerate(P.LLM_LEAK_PATTERNS)]
    for r in edge_df.select("i", *exprs).orderBy("i").collect():
        s = EDGE[r["i"]].lower()
        for k, p in enumerate(P.LLM_LEAK_PATTERNS):
            assert r[f"p{k}"] == bool(re.search(p, s)), (p, s)


def test_counts_and_tokens_match_python(edge_df):
    pats = [P.URL_PATTERN, P.HASHTAG_PATTERN, P.MENTION_PATTERN, P.EMOJI_PATTERN, r"\.\.\."]
    exprs = [count_matches(F.col("t"), p).alias(f"c{k}") for k, p in enumerate(pats)]
    for r in edge_df.select("i", "tok", *exprs).orderBy("i").collect():
        s = EDGE[r["i"]]
        assert list(r["tok"]) == s.split()
        for k, p in enumerate(pats):
            assert r[f"c{k}"] == len(re.findall(p, s)), (p, s)


def test_boundary_forms():
    assert java_regex(r"\bDM\b").startswith("D(?<!")
    assert "(?<=" in java_regex(r"\babonne[zr]?\b")
    assert java_regex(r"a$") == r"a(?=\n?\z)"


def test_word_set_any_matches_python(edge_df):
    rows = edge_df.select("i", word_set_any(F.col("t"), F.col("low"), P.SLANG_PATTERN)
                          .alias("s")).orderBy("i").collect()
    for r in rows:
        s = EDGE[r["i"]]
        assert r["s"] == bool(re.search(P.SLANG_PATTERN, s, re.I)), s
