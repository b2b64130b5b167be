"""The stages in a row, and each stage against plain rules on its own input."""

import zlib

import numpy as np

import corpus_pipeline as P
from acctsig.llm import pieces
from acctsig.llm.common import scratch
from acctsig.llm.queries import ORACLES, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_last_one_kept(spark):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] > 0
    assert sizes[1] >= 0.97 * sizes[0]
    rows = docs.select("doc_id", "text").collect()
    encode = pieces.encoder(vocabulary("word_bpe_49k.json"))
    ids = [[*x, 1] for x in encode([r.text or "" for r in rows])]
    want = sorted((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids))
    out = P.tokens(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in P.run(spark, SF).collect()) == want


def test_odd_documents_pass(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long"
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    rows = [(*r, 1) for r in base] + [(9000, None, None, None, None, None), (9001, "", "en", "s", 0, 0), (None, "the tree is", None, None, 3, 3),
                                      (9002, "the sea " * 40_000, "en", "s", 1, 1), (*base[0], 1), (*base[0], 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), schema)
            else:
                assert out.count() == docs.count()


def test_one_query_for_each_operator():
    names = [q.split("_")[0] for q in QUERIES if q != "pipeline"]
    assert names == [f"op{n}" for n in range(1, 14)] and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)


def test_language_stage_drops_texts_in_no_learned_language(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = [
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem",
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
        "asdf jkl qwer uiop zxcv hjkl sdfg wert xcvb " * 5,
        "dGhlIHF1aWNrIGJyb3duIGZveCBqdW1wcyBvdmVyIHRoZSBsYXp5IGRvZyAxMjM0NTY3ODkwIQ" * 4]
    own = ["all human beings are born free and equal in dignity and rights they are endowed with reason", "the tree is"]
    rows = [(-1 - i, t, None, None, None) for i, t in enumerate([*foreign, *own])]
    docs = clean.unionByName(spark.createDataFrame(rows, clean.schema))
    kept = {r.doc_id for r in P.language(spark, docs, SF).select("doc_id").collect()}
    assert [i for i, *_ in rows if i in kept] == [-6, -7]
    lettered = clean.filter("text RLIKE '[a-zA-Z]'").count()
    assert len(kept) - 2 >= 0.995 * lettered


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "the sea", None), (2, " 12 ", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in P.language(spark, docs, SF).collect()] == [1]
