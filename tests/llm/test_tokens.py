"""Token shards and token counts against the library itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from acctsig.llm import pieces, tokenbin, tokencount
from acctsig.llm.common import scratch
from acctsig.llm.queries import vocabulary

flat = lambda values: [i for v in values for i in v]
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
ODD = ["", " ", "\n", "a", "a b", " a", "a  b \n\n c ", "it's we'll I'D", "end. of, it!! (so) a.b;c:d", "\nNew\n\nlines,\n then", "Don't stop... U.S.A's!", "x_y z^2 a|b a<b <|x|>", "x\t\n\ny", "x\t y", "é́ ́a", "a b c",
       "<|endoftext|>", "x <|endoftext|>y  <|startoftext|> z", "1234 5,678.90 !!! ???", "日本語 テキスト", " wide　space",
       "ΑΣ ΟΔΟΣ ΣΑΣ", "İstanbul ǅ ß", "\x00 \x1c a\x85b", "​ a﻿ b", "👩‍👩‍👧 ok", "word " * 20_000, "x" * 5_000]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_encode_like_whole_texts(name):
    path = vocabulary(name)
    memo, whole = pieces.Pieces(path, list, flat), pieces.encoder(path)
    rng = random.Random(3)
    glue = [" ", "  ", "\n", " \n ", "\t", " ", "'s ", "."]
    texts = ODD + ["".join(rng.choice(ODD[3:20]) + rng.choice(glue) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for _ in range(2):  # from the library, then remembered
        assert memo.of(texts) == whole(texts)


def test_letters_that_normalise_to_a_mark():
    """No cut after a letter whose normalised form ends in a combining mark."""
    import unicodedata
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalnum()]
    marked = [c for c in letters if not unicodedata.normalize("NFC", c.lower())[-1].isalnum()]
    assert "\u095c" in marked and "İ" in marked and "\ufb2a" in marked
    rng = random.Random(1)
    texts = [f"x{c}{p}y {c}. {c}" for c in marked for p in ".,-("]
    for _ in range(2000):
        texts.append("".join(rng.choice(["a", "Ab", "1", " ", "\n", ".", ",", "'", "-", "ß", rng.choice(letters), rng.choice(marked),
                                         chr(rng.randrange(0x300, 0x370))]) for _ in range(rng.randint(1, 14))))
    for name in NAMES:
        path = vocabulary(name)
        assert pieces.Pieces(path, list, flat).of(texts) == pieces.encoder(path)(texts)


def test_new_words_do_not_look_through_the_memo():
    """What a slice of texts costs does not grow with what the worker remembers."""
    class Held(dict):
        def __iter__(self):
            raise AssertionError("walked through all remembered strings")

    for name in NAMES[:2]:
        path = vocabulary(name)
        memo, whole = pieces.Pieces(path, list, flat), pieces.encoder(path)
        memo.known = Held(memo.known)
        for text in ("Some new words, it's 12 of them.", "some Thinéß words\nÉtait 34² 'S l'été µ ǅ"):
            assert memo.of([text, text]) == whole([text, text])


def test_latin_texts_are_cut_by_the_pattern():
    path = vocabulary("word_bpe_49k.json")
    memo, whole = pieces.Pieces(path, list, flat), pieces.encoder(path)
    plain = [c for c in map(chr, range(0x180)) if pieces.PLAIN.fullmatch(c)]
    assert memo.matches and len(plain) > 300 and not pieces.PLAIN.fullmatch("İ")
    rng = random.Random(5)
    texts = ["".join(rng.choice(plain if rng.random() < 0.5 else "aA'sStlLrRvVeE1. \n") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += [f"x{c}'{d}{c}" for c in plain for d in "sStTdDm"]
    assert memo.of(texts) == whole(texts)


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_pieces_on_any_text(texts):
    for name in NAMES[:2]:
        path = vocabulary(name)
        memo = pieces.worker(path, "test", list, flat)
        assert memo.of(texts) == pieces.encoder(path)(texts)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([1, 7, 64, 512]))
@settings(max_examples=150, deadline=None)
def test_blocks_round_trip(ids, block):
    payload, starts = tokenbin.pack(np.array(ids, np.uint32), block)
    count = len(starts) - 1
    assert (tokenbin.unpack(payload, starts, 0, count - 1, len(ids), block).tolist() if ids else []) == ids
    for k in range(count):
        assert tokenbin.unpack(payload, starts, k, k, len(ids), block).tolist() == ids[k * block:(k + 1) * block]


def test_outliers_are_exceptions():
    ids = np.full(1024, 1000, np.uint32) + np.arange(1024, dtype=np.uint32) % 8
    flat = len(tokenbin.pack(ids)[0])
    ids[[5, 99]] = 2**31
    assert len(tokenbin.pack(ids)[0]) == flat + 2 * 6
    payload, starts = tokenbin.pack(ids)
    assert tokenbin.unpack(payload, starts, 0, 0, 1024).tolist() == ids.tolist()


def test_segment_reads_any_range():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n, dtype=np.uint32) for n in (0, 3, 700, 0, 5000, 1)]
    buf = tokenbin.segment(3, 0, [5, None, 7, 8, 9, -1], docs) + b"\n" + tokenbin.segment(3, 1, [], []) + b"\n"
    one, two = tokenbin.read_segments(buf)
    assert [d for d, _ in one.documents()] == [5, None, 7, 8, 9, -1]
    assert all((a == b).all() for (_, a), b in zip(one.documents(), docs))
    flat = np.concatenate(docs)
    for a, b in [(0, 0), (511, 514), (2, 5704), (5703, 5704)]:
        assert one.ids(a, b).tolist() == flat[a:b].tolist()
    assert two.doc_ids == [] and (one.shard, two.number) == (3, 1)
    with pytest.raises(ValueError):
        list(tokenbin.read_segments(b"x" * 60))


def rows():
    rng = random.Random(8)
    out = [(i * 3 - 20, rng.choice(ODD) + " " + " ".join(rng.choice(ODD[3:20]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    return [*out, (None, "no id"), (None, None), (400, None), (401, ""), out[5], out[5], (out[6][0], "same id, other text"),
            (500, "long text " * 30_000)]


def test_shards_against_the_library(spark):
    name, data = vocabulary("word_bpe_49k.json"), rows()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in data], "doc_id long, text string, shard int, start int").repartition(7)
    path = scratch(spark, "shards")
    tokenbin.write(df, path, name, segment_ids=5_000)
    got = tokenbin.with_starts(tokenbin.read(spark, path)).orderBy("start").collect()
    ids = [[*x, 1] for x in pieces.encoder(name)([t or "" for _, t in data])]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(
        ((i, len(x), c) for (i, _), x, c in zip(data, ids, crc)), key=str)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_empty_shards(spark):
    path = scratch(spark, "shards")
    tokenbin.write(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary("word_bpe_49k.json"))
    assert tokenbin.with_starts(tokenbin.read(spark, path)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_counts_against_the_library(spark, name):
    data = rows()
    df = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, digest string").repartition(4)
    path, cache = vocabulary(name), scratch(spark, "counts")
    want = sorted(((i, len((t or "").encode()), len(x)) for (i, t), x in
                   zip(data, pieces.encoder(path)([t or "" for _, t in data]))), key=str)
    for half in (df.filter("doc_id % 2 = 0"), df, df):  # a cold, a partly and a fully filled cache
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.counted(half, path, cache).collect()), key=str)
        assert got == [w for w in want if half is df or (w[0] is not None and w[0] % 2 == 0)]
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t in data})
    assert stored.select("digest").distinct().count() == distinct
    # what the cache holds is not encoded again: each content has a row (a repeated row may have been appended twice)
    assert stored.count() <= distinct + 2


def test_versions_do_not_mix(spark):
    df = spark.createDataFrame([(1, "Some MIXED case text 12345")], "doc_id long, text string")
    cache = scratch(spark, "counts")
    a, b = (tokencount.counted(df, vocabulary(n), cache).first().n_tokens for n in NAMES[:2])
    assert a != b and spark.read.parquet(cache).count() == 2
    assert tokencount.counted(df.limit(0), vocabulary(NAMES[0]), cache).count() == 0
