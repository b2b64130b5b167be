"""Benchmark leaks against a full edit-distance search."""

import random

import numpy as np
import pytest

from acctsig.llm import decontam
from acctsig.llm.decontam import RATE, codepoints, normalised

DOCS = "doc_id long, text string, item_id long, edits string"


def sellers(pattern, text):
    """Least edits of the pattern against any part of the text, by the full recurrence."""
    row = np.arange(len(pattern) + 1)
    best = row[-1]
    for c in text:
        diag = np.empty_like(row)
        diag[0] = 0
        diag[1:] = np.minimum(row[:-1] + np.array([p != c for p in pattern]), row[1:] + 1)
        ramp = np.minimum.accumulate(diag - np.arange(len(diag)))
        row = ramp + np.arange(len(diag))
        best = min(best, row[-1])
    return int(best)


def prose(rng, n):
    syllables = ["the", "an", "er", "on", "tion", "ß", "ré", "ing", " ", " ", ". ", "\n"]
    return "".join(rng.choice(syllables) for _ in range(n))


def spoilt(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t))
        kind = rng.randint(0, 2)
        if kind == 0:
            t[at] = "#"
        elif kind == 1:
            t.insert(at, "#")
        else:
            del t[at]
    return "".join(t)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(21)
    items = [(i, prose(rng, rng.randint(25, 110))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = []
    for d in range(90):
        text = prose(rng, rng.randint(0, 200))
        if d % 3 == 0:
            item = rng.choice(items[:12])[1]
            part = item if d % 2 else item[rng.randrange(20):]
            text += " " + spoilt(rng, part.upper() if d % 5 == 0 else part, rng.randint(0, 14)) + " " + prose(rng, 30)
        docs.append((d, text))
    docs += [(200, None), (201, ""), (None, items[3][1]), docs[3], docs[3], (202, prose(rng, 4000) + items[5][1])]
    return docs, items


def expected(docs, items):
    out = set()
    for d, (_, text) in enumerate(docs):
        t = codepoints(normalised(text))
        for i, item in items:
            for p in decontam.cut(normalised(item)):
                if sellers(codepoints(p), t) <= int(len(p) * RATE):
                    out.add((d, i))
                    break
    return out


def test_slices_find_what_a_full_search_finds(data, monkeypatch):
    docs, items = data
    want = expected(docs, items)
    assert len({d for d, _ in want}) > 15
    patterns = decontam.Patterns([(i, t) for i, t in items if t])
    texts = [t for _, t in docs]
    assert {(d, i) for d, i, *_ in decontam.leaks_of(texts, patterns)} == want
    monkeypatch.setattr(decontam, "TEXT_SLICE", 500)  # long texts are cut into overlapping parts
    assert {(d, i) for d, i, *_ in decontam.leaks_of(texts, patterns)} == want


def test_banded_alignment_equals_the_full_one():
    rng = random.Random(5)
    for _ in range(60):
        p = prose(rng, 20)[:60]
        if len(p) < 20:
            continue
        t = prose(rng, 5) + spoilt(rng, p, rng.randint(0, 5)) + prose(rng, 5)
        a, b = codepoints(p), codepoints(t)
        hit = decontam.banded([a], b, np.array([-len(a)]), len(b) + 2 * len(a), np.array([8]))[0]
        best = sellers(a, b)
        assert (hit[2] if hit else None) == (best if best <= 8 else None)
        if hit:
            assert sellers(a, b[hit[0]:hit[1]]) == hit[2]


def test_operator_on_tables(spark, data):
    docs, items = data
    df = spark.createDataFrame([(d, t, 7, "clash") for d, t in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(i, t, "more") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted((str(docs[d][0]), i) for d, i in expected(docs, items))
    got = decontam.leaks(df, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == want
    assert all(r.edits <= r.matched_chars * RATE + 1 for r in got)
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns
    dirty = {d for d, _ in expected(docs, items)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for n, (x, _) in enumerate(docs) if n not in dirty)


def test_a_large_benchmark_goes_in_parts(spark, data, monkeypatch):
    docs, items = data
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 700)
    got = decontam.leaks(df, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted((str(docs[d][0]), i) for d, i in expected(docs, items))


def test_empty_tables(spark, data):
    df = spark.createDataFrame(data[0], "doc_id long, text string")
    bench = spark.createDataFrame(data[1], "item_id long, text string")
    assert decontam.leaks(df, bench.limit(0)).count() == 0
    assert decontam.without_leaks(df, bench.limit(0)).count() == len(data[0])
    assert decontam.leaks(df.limit(0), bench).count() == 0


def test_whole_passages_of_the_driver_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    passages = [(r.item_id, normalised(r.text)) for r in bench.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() for i, p in passages if p in normalised(r.text)}
    assert whole and whole <= {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}


def test_every_passage_of_an_item_is_found():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdegilmnorstuvé") for _ in range(rng.randint(1, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 16, 25, 40))] + [(4, "字" * 20 + "".join(map(chr, range(0x4E00, 0x4E80))))]
    patterns = decontam.Patterns(items)
    for i, t in items:
        size = decontam.PASSAGE + decontam.STEP - 1
        taken = [t[s:s + size] for s in range(len(t) - size + 1)]
        assert taken
        texts = ["xyz " * 20 + p + " zyx" * 20 for p in taken]
        assert {row for row, item, *_ in decontam.leaks_of(texts, patterns) if item == i} == set(range(len(texts)))


def test_short_items_are_found_as_they_are(spark):
    items = [(1, "42"), (2, "The  Answer"), (3, "naïve guess of a short test item"), (4, "!"), (5, "new york city"), (6, "the answer")]
    docs = [(1, "it is 42."), (2, "it is 421 or 142"), (3, "(the\nanswer)"), (4, "the answers"), (5, "A Naïve guess of a short test item"),
            (6, "a naïve guess of a long test item"), (7, "wow!!"), (8, "new york"), (9, None), (10, "42"), (11, "new york"), (12, "city")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.leaks(df, bench).collect())
    assert got == [(1, 1, 0, 2), (3, 2, 0, 10), (3, 6, 0, 10), (5, 3, 0, 32), (7, 4, 0, 1), (10, 1, 0, 2)]
    assert sorted(r.doc_id for r in decontam.without_leaks(df, bench).collect()) == [2, 4, 6, 8, 9, 11, 12]


def test_items_without_an_id_are_sought(spark, data):
    item = data[1][3][1]
    bench = spark.createDataFrame([(None, item), (None, "forty two"), (7, item), (8, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, item), (2, "forty two"), (3, "neither")], "doc_id long, text string")
    got = decontam.leaks(df, bench).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in got) == [(1, "7"), (1, "None"), (2, "None")]
    assert [r.doc_id for r in decontam.without_leaks(df, bench.filter("item_id IS NULL")).collect()] == [3]


def test_an_item_of_several_texts_over_many_sets(spark, monkeypatch):
    """However many sets the benchmark is cut into, a document has one row per item, the best."""
    one, two = ("the quick brown fox jumps over the lazy dog near the river bank " * 2, "pack my box with five dozen liquor jugs and sail away at dawn now " * 2)
    bench = spark.createDataFrame([(1, one), (1, two), (2, two.upper())], "item_id long, text string")
    docs = spark.createDataFrame([(7, one + " ... " + two.replace("jugs", "jxgs")), (8, "none of it")], "doc_id long, text string")
    whole = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 60)
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == whole and [r[:2] for r in whole] == [(7, 1), (7, 2)]
