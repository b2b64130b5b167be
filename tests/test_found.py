"""Literals and words found with the per-character statistics, and posts' overlaps, by brute force."""

import random
import re
import statistics
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from acctsig.functions import charstats as cs
from acctsig.functions import patterns as P
from acctsig.functions.text import gate_literals, gated_any, pure_words, spelled_out, word_set_any
from acctsig.operators import lexical as lex
from acctsig.operators import post as post_ops
from acctsig.plans import catalog

ALL = cs.sought([*lex.STYLE_LITERALS, *gate_literals([*P.EN_BAIT_PATTERNS, *P.FR_BAIT_PATTERNS, *P.GENERIC_HASHTAG_PATTERNS]),
                 *gate_literals(P.LLM_LEAK_PATTERNS, False)])
WORDS = cs.sought_words(lex.STYLE_WORDS)


def _texts(n=400, seed=3):
    r = random.Random(seed)
    some = [*ALL, *WORDS, "lol", "LoL_", "ol", "İ", "ſ", "K", "é", "🔒", "\n", " ", "x", "DÉCOUVR", "\x00", "中", "af"]
    out = ["", "dm", "DM", "", "af", " af", "af\n", "Kinda", "perhap", "s", "lolé", "wtf́", "ſis", "In THIS thread",
           "a bit of it", "a bit  of", "just another day", "#love", "clique!", "follow", "voici des versions révisée", "As an AI.", "as an aix"]
    return out + ["".join(r.choice([str.upper, str.lower, str.title, str])(r.choice(some))[r.choice([0, 0, 0, 1]):]
                          + r.choice(["", " ", "-"]) for _ in range(r.randrange(6))) for _ in range(n)]


def test_literals_and_words_by_brute_force():
    texts = _texts()
    got = cs.stats_frame(pd.Series([*texts, None], dtype=object), cs.Literals(ALL),
                         np.array([cs._word_key(w) for w in WORDS], dtype=np.uint64))
    for i, t in enumerate([*texts, ""]):
        low = t.lower()
        found = {k for j, k in enumerate(ALL) if int(got[f"found{j // cs.PER_LONG}"][i]) >> (j % cs.PER_LONG) & 1}
        want = {k for k in ALL if k in low}
        assert found == want, t
        assert bool(got["exotic"][i]) == any(x in low for x in "ſı̇"), t
        if not got["exotic"][i]:
            assert bool(got["word_hit"][i]) == bool(set(re.findall(r"\w+", low)) & set(WORDS)), t
    empty = cs.stats_frame(pd.Series([], dtype=object), cs.Literals(ALL), np.array([1], dtype=np.uint64))
    assert len(empty) == 0


def test_flags_are_those_of_the_plain_gates(spark):
    df = spark.createDataFrame(list(enumerate(_texts())), "i int, t string").repartition(3)
    words = tuple(WORDS)
    own = df.select("i", "t", F.lower("t").alias("low"), cs.char_stats(F.col("t"), ALL, words).alias("cs"))
    t, low, found = F.col("t"), F.col("low"), cs.Found(F.col("t"), F.col("cs"), ALL, words)
    lists = [[P.FORMAL_PATTERN], [P.AI_PHRASE_PATTERN], [P.GENERIC_LIFE_PATTERN], P.EN_BAIT_PATTERNS, P.FR_BAIT_PATTERNS,
             P.GENERIC_HASHTAG_PATTERNS]
    cols = [(gated_any(t, low, x, True), gated_any(t, found, x, True, found.exotic())) for x in lists]
    cols.append((gated_any(low, low, P.LLM_LEAK_PATTERNS), gated_any(found.column, found, P.LLM_LEAK_PATTERNS)))
    cols.append((word_set_any(t, low, P.SLANG_PATTERN), word_set_any(t, found, P.SLANG_PATTERN, found.exotic())))
    rows = own.select("t", *[c.alias(f"{s}{i}") for i, pair in enumerate(cols) for s, c in zip("ab", pair)]).collect()
    for r in rows:
        for i in range(len(cols)):
            assert r[f"a{i}"] == r[f"b{i}"], (i, r["t"])
    assert all(len({r[f"a{i}"] for r in rows}) == 2 for i in range(len(cols)))


def test_gates_by_whole_matches():
    """A common word is no gate where the whole phrase is known."""
    assert spelled_out("(a|the) (bit|dose) of") == ["a bit of", "a dose of", "the bit of", "the dose of"]
    assert spelled_out("x(?:y|z)") == ["xy", "xz"] and spelled_out("a+") is spelled_out(r"\ba") is spelled_out("[ab]") is None
    assert not {" of", "this"} & set(lex.STYLE_LITERALS) and "in this post" in lex.STYLE_LITERALS


def test_flags_look_for_no_word_in_the_jvm(spark):
    """The posts' words are not extracted and their texts not lower-cased for all posts."""
    df = spark.createDataFrame([(30, "a", 0, "en", "lol")], "dataset_id long, author_id string, post_seq long, lang string, text string")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (lex.post_style_flags(df), post_ops.post_features(df))]
    assert "regexp_extract_all" not in plans[0] and not any("AS _low" in x for x in plans)
    assert pure_words(P.SLANG_PATTERN)[1] == [r"\bain't\b"]


def test_overlaps_by_brute_force(spark):
    r = random.Random(5)
    rows = [(30, f"a{i % 7}", i, datetime(2024, 1, 1), "en", r.choice([None, " ", "A b", " ".join(r.choices("aBcdÉ", k=r.randrange(1, 8)))]))
            for i in range(320)] + [(31, "once", 1, datetime(2024, 1, 1), "en", "x y")]
    df = spark.createDataFrame(rows, "dataset_id long, author_id string, post_seq long, created_at timestamp, lang string, text string")
    got = {x["author_id"]: x for x in lex.overlaps(df.repartition(5)).collect()}
    one = {x["author_id"]: x for x in lex.consecutive_jaccard(df).join(lex.repeated_bigrams(df), ["dataset_id", "author_id"]).collect()}
    assert len(got) == len(one) == 8
    for author, row in got.items():
        posts = [(x[5] or "").lower().split() for x in sorted((y for y in rows if y[1] == author), key=lambda y: y[2])]
        sets = [set(p) for p in posts]
        js = [len(a & b) / len(a | b) for a, b in list(zip(sets, sets[1:]))[:40] if a | b]
        grams = [{(a, b) for a, b in zip(p, p[1:])} for p in posts]
        both = [len(grams[i] & grams[j]) for i in range(min(30, len(posts))) for j in range(i + 1, min(i + 5, len(posts)))
                if grams[i] and grams[j]]
        want = (statistics.fmean(js) if js else 0, statistics.pstdev(js) if js else 0, sum(both) / max(len(both), 1))
        for x in (row, one[author]):
            assert np.allclose([x[c] for c in lex.OVERLAPS], want), author


def test_overlaps_move_the_texts_once(spark):
    df = spark.createDataFrame([(30, "a", 0, "x")], "dataset_id long, author_id string, post_seq long, text string")
    plan = lex.overlaps(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan


def test_arrivals_keep_signals_without_texts(spark, monkeypatch):
    """Each arrival's texts are read once, for both its aggregations."""
    kept = []
    monkeypatch.setattr(catalog, "kept", lambda df: kept.append(df.columns) or df.persist())
    catalog.QUERIES["state_rollup"](spark, "/root/testdata/sf0.001")
    assert len(kept) == 3 and not any("text" in c for c in kept)


def test_packed_counts_give_what_rows_per_word_give(spark):
    """Richness, topics, vocabulary and weights from packed counts, without a row per account and word."""
    from acctsig.functions import wordcounts as wc
    from acctsig.operators import similarity as sim
    r = random.Random(9)
    rows = [(30 + i % 2, i % 11, r.choice([None, " ", " ".join(r.choices(["Game", "a1", "É", "día", "longwordhere", "x_y", "song", "b"], k=9))]))
            for i in range(200)]
    df = spark.createDataFrame(rows, "dataset_id long, author_id long, text string").repartition(5)
    k = ["dataset_id", "author_id"]
    packed = wc.packed_counts(df, "text", k).persist()
    tokens, terms = (packed.where(F.col("kind") == x) for x in (wc.TOKEN, wc.TERM))
    tc = lex.token_counts(df)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(lex.word_features(tokens), lex.richness(tc).join(lex.topic_coverage(tc, spark), k))
    sizes = sim.corpus_sizes(df)
    vocab = sim.vocabulary(sim.term_counts(df), sizes)
    assert vocab.count() and same(vocab, sim.vocabulary_of(wc.corpus_sums(terms, k).withColumnRenamed("word", "term"), sizes))
    units = lambda u: {(x["dataset_id"], x["author_id"]): dict(zip(x["idx"], np.round(x["u"], 9))) for x in u.collect()}
    assert units(sim.unit_arrays(df, vocab)) == units(sim.unit_arrays(df, vocab, packed=terms)) != {}


def test_matrix_joins_texts_to_posts_of_known_authors_only(spark):
    """The rows that texts are added to are those of known authors, once all and once the first posts."""
    from acctsig.operators import assemble as asm
    acc = spark.createDataFrame([(30, 1, "n", "u", None, None, None, 0.5)],
                                "dataset_id long, id long, name string, username string, description string, location string, tweet_count long, z_score double")
    posts = spark.createDataFrame([(30, a, i, datetime(2024, 1, 1, i % 24), "en") for i, a in enumerate([1] * 50 + [2] * 20)],
                                  "dataset_id long, author_id long, post_seq long, created_at timestamp, lang string")
    given = []

    def texts(keyed):
        given.append(keyed.count())
        return keyed.withColumn("text", F.concat(F.lit("Word lol "), (F.col("post_seq") % 3).cast("string")))

    whole = texts(posts)
    given.clear()
    got = asm.feature_matrix(spark, acc, posts, texts=texts).collect()
    assert given == [50, lex.FIRST_POSTS]
    assert got == asm.feature_matrix(spark, acc, whole).collect() and len(got) == 1


def test_known_authors_are_told_without_orders(spark):
    """Whether an author is known needs the customers only."""
    d = "/root/testdata/sf0.001"
    keyed = catalog.fixture_ekeys(spark, d)
    assert "orders" not in " ".join(keyed.inputFiles())
    from acctsig.sources import fixture as fx
    from acctsig.sources import tables as src
    want = src.eligible_posts(fx.post_keys(spark, d), fx.accounts(spark, d))
    assert keyed.count() == want.count() and keyed.exceptAll(want).isEmpty()
