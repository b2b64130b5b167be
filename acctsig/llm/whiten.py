"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the embeddings' covariance V are found without
forming V. A block Q of ``want + GUARD`` directions is multiplied by V in
distributed passes: each task centres its rows and adds up Xᵀ(XQ), and the
tasks' sums are added up in levels, so that the driver receives at most
``FAN`` matrices of the size of Q, whatever the number of rows. Between
Rayleigh-Ritz steps a Chebyshev polynomial of V, evaluated by its three-term
recurrence (one pass a degree), damps the unwanted part of the spectrum: from
a lower bound, by a short Lanczos run, to the smallest Ritz value of the block.
Then come QR, Rayleigh-Ritz and the certificate: the residuals ‖Vq - eq‖ of
all wanted pairs, which must be under ``TOLERANCE`` of the largest eigenvalue
and no longer fall.

Entries c become x = floor(64 c) + 1000000. Their sums are exact integers, and
rows are centred in two parts (integer mean and the rest) before any product,
so the large offset costs no digits.

Defined results. Rows take part whose vector is not null, holds no null or
non-finite entry and has the most frequent length (ties: the greater); an empty
vector has none. A null id is an id like any other and repeated rows count as
often as they occur. x stops at ±2^62. Components whose eigenvalue is
numerically zero can't be scaled to unit variance and are left out; so equal
vectors, a single one, or an empty table give no rows. A ``deviation`` beyond a
long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm.common import field, prepare, scratch

COMPONENTS = 32
GUARD = 16  # further directions in the block
DEGREE = 10  # of the filter at most
LANCZOS = 10
SPREAD = 1e7  # largest amplification of one wanted direction over another in one filter
TOLERANCE = 1e-12
ROUNDS = 100
FAN = 32
ROWS = 4_096  # rows that a task holds at once, as doubles
SCALE, OFFSET = 64, 1_000_000
_STOP = 1 << 62
_LONG = (1 << 63) - 1

PART = T.StructType([T.StructField("slot", T.LongType()), T.StructField("body", T.BinaryType())])


# -- distributed sums --------------------------------------------------------

def _floors(col: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """floor(64 c) of the vectors of an array column, as doubles, some rows at a time."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    c = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for i in range(0, len(c), ROWS):
        yield np.clip(np.floor(c[i:i + ROWS].astype(np.float64) * SCALE), -_STOP, _STOP)


def _slot() -> int:
    return TaskContext.get().partitionId()


def _part(body: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_slot()], pa.int64()), pa.array([body.tobytes()], pa.binary())],
                                      names=["slot", "body"])


def _total(parts: list[tuple[int, bytes]], dtype) -> np.ndarray:
    return np.sum([np.frombuffer(b, dtype) for _, b in sorted(parts)], axis=0)


def summed(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray | None], dtype, partitions: int) -> np.ndarray | None:
    """The sum of ``of_batch`` over all batches of ``rows``, or None without rows.

    Each task adds up its batches; the tasks' sums are added up ``FAN`` at a
    time in further stages until ``FAN`` or so are left for the driver.
    """
    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                s = of_batch(b)
                total = s if total is None else total + s
        if total is not None:
            yield _part(total)

    def merged(batches):
        parts = [(r["slot"], r["body"]) for b in batches for r in b.to_pylist()]
        if parts:
            yield _part(_total(parts, dtype))

    sums = rows.mapInArrow(partial, PART)
    while partitions > FAN:
        partitions = -(-partitions // FAN)
        sums = sums.repartition(partitions, "slot").mapInArrow(merged, PART)
    found = [(r.slot, bytes(r.body)) for r in sums.collect()]
    return _total(found, dtype) if found else None


@dataclass
class Fit:
    """Rows, per-dimension sums and, once found, components of a table of vectors."""
    rows: DataFrame  # id, vec
    partitions: int
    dim: int
    n: int
    sums: list[int]  # of floor(64 c), exact
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    def centring(self) -> tuple[np.ndarray, np.ndarray]:
        """Integer part and rest of the mean of floor(64 c)."""
        whole = [s // self.n for s in self.sums]
        return (np.array(whole, dtype=np.float64),
                np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)]))


def collected(df: DataFrame, id_col: str, vec_col: str) -> Fit | None:
    """The usable rows, written to the shared folder, with their count and sums."""
    spark = prepare(df)
    v = F.col(vec_col)
    path = scratch(spark, "vectors")
    df.select(F.col(id_col).alias("id"), v.alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0)) \
        .filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))) \
        .write.parquet(path)
    kept = spark.read.parquet(path)
    most = kept.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    dim = most["dim"]
    rows = kept.filter(F.size("vec") == dim)
    partitions = rows.rdd.getNumPartitions()

    def of_batch(b):
        s = np.zeros((2, dim), dtype=np.int64)
        for f in _floors(b.column("vec"), dim):
            x = f.astype(np.int64)
            s[0] += (x >> 32).sum(axis=0)
            s[1] += (x & 0xFFFFFFFF).sum(axis=0)
        return s.ravel()

    high, low = summed(rows.select("vec"), of_batch, np.int64, partitions).reshape(2, dim).tolist()
    return Fit(rows, partitions, dim, most["n"], [(h << 32) + lo for h, lo in zip(high, low)])


def times_covariance(fit: Fit, q: np.ndarray) -> np.ndarray:
    """V q, for a block of directions, by one pass over the rows."""
    whole, rest = fit.centring()
    dim, shape = fit.dim, q.shape

    def of_batch(b):
        s = np.zeros(shape)
        for f in _floors(b.column("vec"), dim):
            x = (f - whole) - rest
            s += x.T @ (x @ q)
        return s.ravel()

    return summed(fit.rows.select("vec"), of_batch, np.float64, fit.partitions).reshape(shape) / fit.n


def variances(fit: Fit) -> np.ndarray:
    whole, rest = fit.centring()
    dim = fit.dim

    def of_batch(b):
        return sum((((f - whole) - rest) ** 2).sum(axis=0) for f in _floors(b.column("vec"), dim))

    return summed(fit.rows.select("vec"), of_batch, np.float64, fit.partitions) / fit.n


def identity_gap(fit: Fit, w: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened rows, less the identity."""
    whole, rest = fit.centring()
    dim, k = fit.dim, w.shape[1]

    def of_batch(b):
        s = np.zeros((k + 1, k))
        for f in _floors(b.column("vec"), dim):
            z = ((f - whole) - rest) @ w
            s[:k] += z.T @ z
            s[k] += z.sum(axis=0)
        return s.ravel()

    s = summed(fit.rows.select("vec"), of_batch, np.float64, fit.partitions).reshape(k + 1, k) / fit.n
    return float(np.abs(s[:k] - np.outer(s[k], s[k]) - np.eye(k)).max())


# -- subspace iteration ------------------------------------------------------

def lower_bound(times: Callable[[np.ndarray], np.ndarray], dim: int, steps: int, rng) -> float:
    """A bound, in all likelihood, under the spectrum: smallest Ritz value of a Lanczos run less its residual."""
    q = rng.standard_normal(dim)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dim)):
        r = times(basis[-1][:, None])[:, 0]
        alphas.append(float(basis[-1] @ r))
        for _ in range(2):
            r -= np.array(basis).T @ (np.array(basis) @ r)
        betas.append(float(np.linalg.norm(r)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(r / betas[-1])
    k = len(alphas)
    t = np.diag(alphas) + np.diag(betas[:k - 1], 1) + np.diag(betas[:k - 1], -1)
    e, u = np.linalg.eigh(t)
    return max(0.0, float(e[0] - betas[-1] * abs(u[-1, 0])))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float,
             top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V, at most 1 on [low, high] and scaled to the value at ``top``, times q."""
    half, mid = max((high - low) / 2, 1e-12 * top), (high + low) / 2
    first = sigma = half / (top - mid)
    before, now = q, (vq - mid * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - mid * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def degree_for(values: np.ndarray, want: int, low: float, high: float) -> int:
    """The degree, up to ``DEGREE``, at which no wanted direction outgrows another by more than ``SPREAD``."""
    half, mid = max((high - low) / 2, 1e-12 * values[0]), (high + low) / 2
    growth = np.arccosh(np.maximum(1.0, (values[[0, want - 1]] - mid) / half))
    gap = growth[0] - growth[1]
    return max(2, min(DEGREE, int(np.log(SPREAD) / gap) if gap > 0 else DEGREE))


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, want: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of V, falling, and unit eigenvectors.

    Raises ``ArithmeticError`` if they can't be certified in ``ROUNDS`` rounds.
    """
    want = min(want, dim)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dim, min(dim, want + GUARD))))[0]
    low, best = None, np.inf
    for _ in range(ROUNDS):
        vq = times(q)
        h = q.T @ vq
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        if e[0] <= 0:  # no variance at all
            return np.zeros(want), q[:, :want]
        left = float(np.linalg.norm(vq[:, :want] - q[:, :want] * e[:want], axis=0).max() / e[0])
        if q.shape[1] == dim or (left <= TOLERANCE and left > 0.5 * best):
            return e[:want], q[:, :want]
        best = min(best, left)
        if low is None:
            low = lower_bound(times, dim, LANCZOS, rng)
        high = max(float(e[-1]), low)
        y = filtered(times, q, vq, low, high, float(e[0]), degree_for(e, want, low, high))
        norms = np.linalg.norm(y, axis=0)
        q = np.linalg.qr(y / np.where(norms > 0, norms, 1.0))[0]
    raise ArithmeticError(f"components not certified: residual {left:.3g} of the largest eigenvalue")


def fitted(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Components of the table's usable vectors, or None if there are none."""
    fit = collected(df, id_col, vec_col)
    if fit is None:
        return None
    fit.trace = float(variances(fit).sum())
    e, q = leading(lambda block: times_covariance(fit, block), fit.dim, components)
    some = e > fit.dim * 16 * np.finfo(float).eps * max(e[0], 0.0)
    fit.values, fit.vectors = e[some], q[:, some]
    if some.any():
        fit.identity_error = identity_gap(fit, fit.vectors / np.sqrt(fit.values))
    return fit


# -- whitened rows -----------------------------------------------------------

def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)², exact; None beyond a long."""
    whole = [s // n for s in sums]
    y = x - np.array(whole, dtype=np.int64)
    most = n * int(np.abs(y).max(initial=0)) + n
    if most * most * max(1, x.shape[1]) <= _LONG:
        u = n * y - np.array([s - w * n for s, w in zip(sums, whole)], dtype=np.int64)
        return (u * u).sum(axis=1).tolist()
    left = [s - w * n for s, w in zip(sums, whole)]
    totals = (sum((n * v - r) ** 2 for v, r in zip(row, left)) for row in y.tolist())
    return [t if t <= _LONG else None for t in totals]


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` per usable row and component."""
    schema = T.StructType([field(df, id_col), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    fit = fitted(df, id_col, vec_col, components)
    if fit is None or not len(fit.values):
        return df.sparkSession.createDataFrame([], schema)
    whole, rest = fit.centring()
    n, sums, dim, k, gap = fit.n, fit.sums, fit.dim, len(fit.values), fit.identity_error
    w, share = fit.vectors / np.sqrt(fit.values), fit.values / fit.trace
    names = schema.names

    def placed(batches):
        for b in batches:
            done = 0
            for f in _floors(b.column("vec"), dim):
                m = len(f)
                ids = b.column("id").slice(done, m).take(pa.array(np.repeat(np.arange(m), k)))
                done += m
                z = ((f - whole) - rest) @ w
                dev = pa.array(_deviations(f.astype(np.int64), n, sums), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                     dev.take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()), pa.array(np.tile(share, m)),
                     pa.array(np.full(m * k, gap))], names=names)

    return fit.rows.select("id", "vec").mapInArrow(placed, schema)
