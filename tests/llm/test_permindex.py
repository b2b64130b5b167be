"""The permutation index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctsig.llm import permindex

SF = "/root/testdata/sf0.1"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:min(k, len(ids) - 1)]
        out[q] = [(int(ids[b]), float(d[b])) for b in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_driver_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = rows.orderBy("vec_id").toArrow()
    ids = t.column("vec_id").to_numpy()
    x = np.stack([np.asarray(v, float) for v in t.column("embedding").to_pylist()])
    want = brute(ids, x, ids[ids % 100 == 0].tolist(), 10)
    got = found(permindex.searched(rows, F.col("vec_id") % 100 == 0, shard=2_000, least=200))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    for q in got:
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        for i, d in got[q]:
            assert d == pytest.approx(float(np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum())), rel=1e-12)


@pytest.mark.parametrize("shard,block", [(10_000, 2_048), (37, 3)])
def test_exact_where_all_are_reranked(spark, shard, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).round(1)
    x[50:120] = x[50]  # one very common vector: ties go to the smaller id
    ids = rng.permutation(1000)[:300]
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rank int")
    got = found(permindex.searched(df, F.col("vec_id") % 10 == 0, k=7, shard=shard, query_block=block))
    assert got == brute(ids, x, [int(i) for i in ids if i % 10 == 0], 7)


def test_recall_beside_a_very_common_vector(spark):
    """A third of the rows are one vector; a shard's candidates are few."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    x[::3] = x[0]
    ids = np.arange(3000)
    df = spark.createDataFrame([(i, v) for i, v in zip(ids.tolist(), x.tolist())], "vec_id long, embedding array<double>")
    got = found(permindex.searched(df, F.col("vec_id") % 100 == 0, share=0.15, least=100))
    want = brute(ids, x, [i for i in ids.tolist() if i % 100 == 0], 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_footrule():
    rng = np.random.default_rng(7)
    pivots, x = rng.normal(size=(20, 5)), rng.normal(size=(40, 5))
    s = permindex.Shard(np.arange(40), x, pivots, 6)
    x = s.vectors
    order = permindex.permutations(x, pivots, 6)
    place = np.full((40, 20), 6)
    np.put_along_axis(place, order, np.arange(6)[None].repeat(40, 0), 1)
    for q in range(40):
        assert s.footrule(order[q]).tolist() == np.abs(place - place[q]).sum(axis=1).tolist()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1, [1.0, 1.0]), (0, [5.0, 5.0]), (100, [0.0, 0.0]), (200, [-inf, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = found(permindex.searched(df, F.col("vec_id") % 100 == 0))
    assert got == {0: [(9, 0.0), (1, 1.0)]}
    assert permindex.searched(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    one = df.filter("vec_id = 9")
    assert permindex.searched(one, F.col("vec_id") == 9).count() == 0
