"""Fourth round's findings: work that was done several times, or word by word."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from acctsig.functions import wordcounts as wc
from acctsig.operators import lexical as lex
from acctsig.operators import temporal as temp
from acctsig.plans import catalog
from tests.test_fixture_scale import plan, tables  # noqa: F401

WORDS = ["a", "B", "ü", "c\x1fd", "É x", "Σς", "ΑΣ", "İb", "x_1²", "don't", "٣٤", "áb", "　", "\x85", "🤖ok", "the", "end"]


def some_text(r):
    return r.choice([None, "", " \x1c "]) if r.random() < 0.2 else " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9)))


def packed(accounts, kinds=(wc.TOKEN, wc.TERM)):
    """Batches of packed counts, by account and kind, of {author: texts}: a batch a text."""
    rows = []
    for author, texts in accounts.items():
        for t in texts:
            b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([author]), pa.array([t], pa.string())], names=["d", "a", "t"])
            for out in wc._of_batches(2, kinds, lambda c: c)([b]):
                rows += out.to_pylist()
    rows.sort(key=lambda r: (r["a"], r["kind"]))
    return [pa.RecordBatch.from_pylist(rows[i:i + 3]) for i in range(0, len(rows), 3)]


@pytest.mark.parametrize("merged", [1, 200, 1 << 24])
def test_counts_are_those_of_python_however_an_account_is_cut(monkeypatch, merged):
    monkeypatch.setattr(wc, "MERGED", merged)
    r = random.Random(merged)
    accounts = {a: [some_text(r) for _ in range(40 if a == 3 else r.randint(1, 5))] for a in range(8)}
    got = {}
    for c in wc._by_account(packed(accounts), 2):
        words = c.words.to_pylist()
        for of, code, n in zip(c.of.tolist(), c.code.tolist(), c.n.tolist()):
            _, author, kind = c.keys[of]
            assert got.setdefault((author, kind, words[code]), n) is n  # an account comes once
    want = Counter()
    for a, texts in accounts.items():
        for t in texts:
            want.update((a, wc.TOKEN, w) for w in (t or "").lower().split())
            want.update((a, wc.TERM, w) for w in wc._TERMS.findall((t or "").lower()))
    assert got == want and want


def _plainly(texts, pairs, anchors, lookahead):
    found = [(t or "").lower().split() for t in texts]
    sets = [set(w) for w in found[:pairs + 1]] if pairs else []
    shares = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:]) if a | b]
    grams = [set(zip(w, w[1:])) for w in found[:anchors + lookahead]] if anchors else []
    shared = [len(a & b) for i, a in enumerate(grams[:anchors]) for b in grams[i + 1:i + 1 + lookahead] if a and b]
    return [np.mean(shares) if shares else 0.0, np.std(shares) if shares else 0.0, sum(shared) / max(len(shared), 1)]


@pytest.mark.parametrize("pairs,anchors,lookahead", [(40, 30, 4), (3, 2, 2), (40, 0, 0), (0, 5, 4), (1, 1, 1)])
def test_overlaps_are_those_of_sets(pairs, anchors, lookahead):
    r = random.Random(pairs)
    for n in range(1, 14):
        texts = [some_text(r) for _ in range(min(n, max(pairs + 1 if pairs else 0, anchors + lookahead)))]
        rn = r.sample(range(1, len(texts) + 1), len(texts))
        table = pa.table({"a": [7] * len(texts), "rn": rn, "t": pa.array([texts[i - 1] for i in rn], pa.string())})
        assert np.allclose(lex._overlaps_of(table, 1, pairs, anchors, lookahead), _plainly(texts, pairs, anchors, lookahead), atol=1e-12)


def test_topic_coverage_reads_the_texts_once(spark, tables):  # noqa: F811
    df = catalog.QUERIES["topic_coverage"](spark, tables)
    assert plan(df).count("MapInArrow") == 2  # counted per batch, added up per account
    assert df.count() > 0


def test_topic_coverage_of_words_in_two_topics_in_none_and_of_null_keys(spark):
    rows = [(1, 1, "goal", 2), (1, 1, "vote", 1), (1, 1, "zzz", 1), (1, 2, "zzz", 5), (1, None, "goal", 1)]
    tc = spark.createDataFrame(rows, "dataset_id long, author_id long, token string, c long")
    got = {r["author_id"]: r["topic_diversity"] for r in lex.topic_coverage(tc, spark, topics={"a": ["goal", "vote"], "b": ["vote"]}).collect()}
    assert got == {1: 1.0, 2: 0.0, None: 0.0}


def test_the_median_reads_the_gaps_once_a_round(spark):
    rows = [(1, a, v) for a in range(3) for v in (5, 1 << 40, 7, 7 + a)] + [(1, None, 3)]
    d = spark.createDataFrame(rows, "dataset_id long, author_id long, d long")
    df = temp.radix_median(d)
    assert plan(df).count("LogicalRDD") == 3
    assert {r["author_id"]: r["median"] for r in df.collect()} == {0: 7.0, 1: 7.5, 2: 8.0}


def test_nodes_split_together_as_alone():
    from acctsig.operators import boost
    rng = np.random.default_rng(4)
    widths = np.array([64, 1, 3, 64, 17])
    ends = np.cumsum(widths)
    for learner in (boost.Learner("a", "leafwise", 1, 0.1, 4, l1=0.3, l2=5.0, gain=0.01, least_rows=5, least_hessian=1e-3),
                    boost.Learner("b", "gamma", 1, 0.1, 4, l1=0.2, l2=2.0, least_hessian=1.5),
                    boost.Learner("c", "residual", 1, 0.1, 3, least_rows=6)):
        dense = np.zeros((3, 6, len(widths), boost.BINS), dtype=np.int64)
        for node in range(6):
            g, h = rng.integers(-boost.UNIT, boost.UNIT, 40 * node), rng.integers(0, boost.UNIT // 4, 40 * node)
            for f, w in enumerate(widths):
                b = rng.integers(0, w, 40 * node)
                for row, v in enumerate((g, h, np.ones(40 * node, dtype=np.int64))):
                    np.add.at(dense[row, node, f], b, v)
        ragged = np.concatenate([dense[:, :, f, :w] for f, w in enumerate(widths)], axis=2)
        cols = np.array([3, 5, 8, 9, 11])
        together = boost.best_splits(learner, ragged, cols, widths)
        assert together == [boost.best_split(learner, dense[:, i], cols) for i in range(6)]
        assert any(s[0] is not None for s in together) and ends[-1] == ragged.shape[2]


def test_a_single_shard_grows_a_tree_without_the_job_per_level_code(spark, monkeypatch):
    from acctsig.operators import boost
    from tests.test_boost import GAMMA, LEAFWISE, RESIDUAL, data, frame
    x, y, fold, key = data(seed=8)
    df, learners = frame(spark, x, y, fold, key), [LEAFWISE, GAMMA, RESIDUAL]
    want = boost.boosted(df, learners, 2, shards=3)
    monkeypatch.setattr(boost, "_tree", None)
    got = boost.boosted(df, learners, 2)
    assert all(np.array_equal(getattr(got[k], a), getattr(want[k], a)) for k in want for a in ("feature", "threshold", "value", "gain"))


def test_bins_are_found_by_one_aggregate(spark):
    from acctsig.operators import boost
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 12)).round(2)
    x[:, 4] = 7.0
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    edges = boost.bin_edges(df)
    want = [np.unique(np.sort(c)[[max(0, int(np.ceil((i + 1) / 64 * 500)) - 1) for i in range(63)]]) for c in x.T]
    assert len(edges) == 12 and all(np.array_equal(a, b) for a, b in zip(edges, want))
    assert boost.bin_edges(df.limit(0)) == []


def test_the_cross_dataset_report_trains_its_pairs_only(spark, tables, monkeypatch):  # noqa: F811
    from acctsig.plans import job
    asked = []
    monkeypatch.setattr(catalog, "_MATRICES", {})
    monkeypatch.setattr(job, "train_by_language", lambda *a, **k: pytest.fail("trains the languages"))
    monkeypatch.setattr(job, "cross_pairs", lambda fm: [(31, 33, "fr"), (33, 31, "fr")])
    monkeypatch.setattr(job.ml, "cross_dataset", lambda spark, fm, a, b, preset, lg, shards: asked.append((a, b, lg)) or fm.select("dataset_id").limit(1))
    assert len(catalog.QUERIES["cross_dataset_report"](spark, tables).columns) == 1
    assert sorted(asked) == [(31, 33, "fr"), (33, 31, "fr")]
