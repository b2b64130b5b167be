"""SimHash groups against brute force over all pairs of fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from acctsig.llm import simhash
from acctsig.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id long"


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
        value |= (2 * ones > len(grams)) << bit
    return value


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(25)]
    out = []
    for b in base:
        for _ in range(rng.randint(1, 8)):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            out.append(rng.choice([" ", "\n", "\t "]).join(w))
    long = " ".join(word() for _ in range(70_000))
    return [*out, None, "", " \n\t", "One", "one", "two words", "TWO  WORDS", "É é", long, long + " x", out[0], out[0]]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    ids = list(range(100, 100 + len(t)))
    random.Random(2).shuffle(ids)
    out = list(zip(ids, t))
    return [*out, (None, t[0]), (None, "alone here with no one else near"), out[3], out[3]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)


def test_groups_match_brute_force(spark, rows):
    g = simhash.groups(frame(spark, rows).repartition(5)).collect()
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in g), key=str)
    assert got == plain_components(rows)


def test_one_row_of_each_group_stays(spark, rows):
    df = frame(spark, rows)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # a component without an id keeps one row, whose id is null
    assert ids == sorted({c for *_, c in plain_components(rows)}, key=str)
    assert {r.fp for r in kept.collect()} == {"clash"}


def test_links_on_dense_fingerprints(spark):
    """Values within a few bits of some centres, so that many pairs lie at 2 to 4 bits."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(60)}
    as_long = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(as_long(x),) for x in fps], "fp long")
    for bits in (0, 1, 2, 3):
        want = {tuple(sorted((as_long(a), as_long(b)))) for a in fps for b in fps
                if a < b and (a ^ b).bit_count() <= bits}
        assert {(r.a, r.b) for r in simhash.links(df, bits).collect()} == want
    with pytest.raises(ValueError):
        simhash.links(df, 4)


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2**63, 2**63, (300, 2))
    x[:100, 1] = x[:100, 0] ^ (1 << rng.integers(0, 62, 100))
    df = spark.createDataFrame(x.tolist(), "a long, b long").select(
        "a", "b", simhash.embedding(simhash.F.col("a")).alias("va"), simhash.embedding(simhash.F.col("b")).alias("vb"))
    counts = lambda v: [(v >> 2 * i & 3).bit_count() for i in range(32)]
    for r in df.collect():
        a, b = r.a % 2**64, r.b % 2**64
        l1 = sum(abs(p - q) for p, q in zip(counts(a), counts(b)))
        assert ((r.va ^ r.vb) % 2**64).bit_count() == l1 <= (a ^ b).bit_count()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (101, 100), (-3, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 100 for i in range(101, 140)}, 200: -3}


def test_empty_table(spark):
    df = frame(spark, [])
    assert simhash.groups(df).count() == 0
    assert simhash.deduplicated(df).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "__own", "__nth", "id", "hash", "row", "n", "a.b"]
    data = [(i, "one two three four", *("keep",) * 7) for i in [5, 5, 7]] + [(9, None, *("keep",) * 7)]
    df = spark.createDataFrame(data, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    out = simhash.deduplicated(df).collect()
    assert sorted(r.doc_id for r in out) == [5, 9]
    assert all(list(r.asDict()) == names and set(r[2:]) == {"keep"} for r in out)
