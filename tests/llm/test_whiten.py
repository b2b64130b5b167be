"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from acctsig.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, component string, n double"


def dense(x, k):
    """Eigenvalues, projected and scaled rows, by the covariance itself."""
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1], u[:, ::-1]
    return e, c @ u[:, :k] / np.sqrt(e[:k])


def table(df):
    r = df.toArrow().sort_by([("vec_id", "ascending"), ("component", "ascending")])
    return {c: r.column(c).to_numpy() for c in r.column_names}


def agree(got, c, k=32):
    x = np.floor(64 * c.astype(np.float32).astype(float))
    e, z = dense(x, k)
    w = got["whitened"].reshape(-1, k)
    assert np.abs(w * np.sign((w * z).sum(axis=0)) - z).max() < 1e-8
    assert got["explained"].reshape(-1, k)[0] == pytest.approx(e[:k] / e.sum(), rel=1e-9)
    n, s = len(x), (x + 1_000_000).sum(axis=0)
    assert got["deviation"].reshape(-1, k)[:, 0].tolist() == [
        sum(int(n * v - t) ** 2 for v, t in zip(row, s)) for row in x + 1_000_000]
    assert set(got["n"]) == {n} and 0 <= got["identity_error"][0] < 1e-9 and len(set(got["identity_error"])) == 1


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = table(whiten.whitened(df))
    t = df.orderBy("vec_id").toArrow()
    assert got["component"].reshape(-1, 32)[0].tolist() == list(range(1, 33))
    agree(got, np.stack(t.column("embedding").to_pylist()))


def test_filter_where_the_block_is_a_part(spark):
    """A steep and a flat spectrum, a third of the rows equal, many partitions: sums in levels."""
    rng = np.random.default_rng(4)
    c = rng.normal(size=(3000, 90)) * np.concatenate([[300, 40, 6], np.linspace(1.2, 0.8, 87)])
    c[::3] = c[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "vec_id long, embedding array<float>")
    agree(table(whiten.whitened(df.repartition(80))), c)


def test_leading_pairs_of_a_plain_matrix():
    rng = np.random.default_rng(5)
    u = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    for e in (np.linspace(2, 1, 120), 0.7 ** np.arange(120.0), np.r_[1e6, np.ones(4), np.zeros(115)]):
        v = (u * e) @ u.T
        got, q = whiten.leading(lambda b: v @ b, 120, 20)
        assert got == pytest.approx(np.sort(e)[::-1][:20], rel=1e-9, abs=1e-9 * e.max())
        assert np.abs(v @ q - q * got).max() <= 1e-11 * e.max()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(6)
    good = rng.normal(size=(40, 5)).round(3)
    rows = [(i, v, "x", 1.0) for i, v in enumerate(good.tolist())]
    odd = [(100, None, None, None), (101, [], "x", 1.0), (102, [nan] * 5, "x", 1.0), (103, [1.0, None, 1.0, 1.0, 1.0], "x", 1.0),
           (104, [1.0, inf, 1.0, 1.0, 1.0], "x", 1.0), (105, [1.0, -inf, 1.0, 1.0, 1.0], "x", 1.0), (106, [1.0, 2.0], "x", 1.0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    agree(table(whiten.whitened(df)), good, 5)
    twice = table(whiten.whitened(spark.createDataFrame(rows + rows[:1] + [(None, good[1].tolist(), "y", 0.0)], SCHEMA)))
    assert len(twice["n"]) == 42 * 5 and set(twice["n"]) == {42}


def test_no_variance_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], None, None)], SCHEMA)
    assert whiten.whitened(one).count() == 0
    assert whiten.whitened(one.unionAll(one)).count() == 0
    assert whiten.whitened(one.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], None, None) for i in range(9)], SCHEMA)
    got = table(whiten.whitened(line))
    assert set(got["component"]) == {1} and got["explained"][0] == pytest.approx(1.0)


def test_deviation_beyond_a_long(spark):
    assert whiten._deviations(np.array([[10 ** 9, 0], [0, 1]]), 5, [10 ** 9, 1]) == [None, (10 ** 9) ** 2 + 16]
    huge = spark.createDataFrame([(0, [3e38, 1.0], None, None), (1, [0.0, 2.0], None, None)], SCHEMA)
    assert whiten.whitened(huge).filter("deviation is not null").count() == 0
