"""Language identification: a plain naive Bayes, and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from acctsig.llm import langid
from acctsig.llm.queries import op9_language

SF = "/root/testdata/sf0.01"


def grams(text):
    t = f" {text.lower()} "
    return [t[i:i + n] for n in langid.SIZES for i in range(len(t) - n + 1)]


def bucket(gram):
    return int(langid.rolling(langid.codepoints(gram), len(gram))[0] >> np.uint64(64 - langid.BITS))


TRAIN = [("en", "the sea and The tree"), ("en", "an apple"), ("de", "der Straße über"), ("fr", "é"), ("de", "und")]


def test_features_are_each_texts_own():
    texts = ["ab", "", "É é", "a" * 50]
    got = Counter()
    for row, b in langid.features(texts):
        got.update(zip(row.tolist(), b.tolist()))
    assert got == Counter((i, bucket(g)) for i, t in enumerate(texts) for g in grams(t))


def test_scores_match_the_definition(spark):
    df = spark.createDataFrame([*TRAIN, (None, "no label"), ("en", None)], "lang string, text string").repartition(3)
    m = langid.learned(df)
    assert m.langs == ["de", "en", "fr"]
    log = {}
    for lang in m.langs:
        own = [t for x, t in TRAIN if x == lang]
        counts = Counter(bucket(g) for t in own for g in grams(t))
        total = sum(counts.values()) + langid.BUCKETS * langid.SMOOTHING
        log[lang] = lambda t, c=counts, n=total, k=len(own): math.log(k / len(TRAIN)) + sum(
            math.log((c[bucket(g)] + langid.SMOOTHING) / n) for g in grams(t))
    texts = ["the", "über der", "sea", "é", "x1"]
    names, scores = m.predict(texts)
    for t, name, score in zip(texts, names, scores):
        s = {lang: f(t) for lang, f in log.items()}
        best = max(s, key=s.get)
        assert name == best
        assert score == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), rel=1e-9)


def test_undetermined_and_odd_rows(spark):
    m = langid.learned(spark.createDataFrame(TRAIN, "lang string, text string"))
    data = [(1, None, "x"), (2, "", "x"), (3, " 12 _ %$\n", "x"), (4, "the " * 50_000, "x"), (None, "und über", "x"), (4, "é", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang_pred string")
    got = langid.predicted(df, m).collect()
    assert sorted(((str(r.doc_id), r.lang_pred) for r in got)) == sorted(
        [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("None", "de"), ("4", "fr")])
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = langid.accepted(df, m)
    assert kept.columns == df.columns and kept.count() == 3
    assert langid.predicted(df.limit(0), m).count() == 0


def test_no_labelled_text(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    m = langid.learned(df)
    assert [(r.lang_pred, r.score) for r in langid.predicted(df, m).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op9_language(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0


def test_many_languages_go_in_blocks(spark, monkeypatch):
    rows = [(f"{x}{i % 3}" if x != "en" else x, f"{t} {i}") for i in range(6) for x, t in TRAIN]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["the", "über der", "sea", "é", "x1", " 12 ", None, ""])], "doc_id long, text string")
    whole = langid.learned(df)
    want = {r.doc_id: r for r in langid.predicted(texts, whole).collect()}
    stays = {r.doc_id for r in langid.accepted(texts, whole, 0.3, below=1.0).collect()}
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    blocks = langid.learned(df)
    assert len(whole.langs) == 7 and [len(b) for b in blocks.langs] == [3, 3, 1]
    got = langid.predicted(texts, blocks).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.lang_pred == want[r.doc_id].lang_pred and r.score == pytest.approx(want[r.doc_id].score, rel=1e-9)
    assert {r.doc_id for r in langid.accepted(texts, blocks, 0.3, below=1.0).collect()} == stays


def test_more_languages_than_one_matrix_holds(spark):
    rows = [(f"l{i}", f"word{i} the sea") for i in range(langid.MOST_LANGS + 6)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    got = langid.predicted(df, langid.learned(df)).collect()
    assert len(got) == len(rows) and sum(r.lang == r.lang_pred for r in got) > 0.9 * len(rows)


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["²", "½ ①", "12 _", "x²", "Ⅷ", "the end"])], "doc_id long, text string, lang string")
    model = langid.learned(docs.filter("doc_id = 5"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 4)) and got[3][0] == got[5][0] == "en"
    assert {r.doc_id for r in langid.accepted(docs, model).collect()} == {3, 5}
