"""Mixing against a plain water-filling and the sampling rules."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest

from acctsig.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target double"


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: Fraction(0) for s in names}
    rest, free = Fraction(sum(sizes.values())), set(names)
    while rest > 0 and free:
        share = rest / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        rest = Fraction(0)
        for s in list(free):
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = Fraction(3 * sizes[s])
                free.discard(s)
    return target


def rows(seed=0):
    rng = random.Random(seed)
    names = ["big", "b", "a", "é", "Z", "empty", "tiny", None]
    out = []
    for i in range(900):
        s = "big" if rng.random() < 0.4 else rng.choice(names)
        n = 0 if s == "empty" else 1 if s == "tiny" else int(rng.paretovariate(0.9) * 5)
        out.append((i, rng.choice([" ", "\n", "\x0b"]).join(["w x"] * min(n, 3000)), s))
    return [*out, (1000, None, "a"), (1001, " \t", "b"), (None, "one two", "a"), out[0], out[0], out[0], (1002, "x y", "only")]


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 1.5) for r in data], SCHEMA)


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_copies(spark, seed):
    data = rows(seed)
    got = mixing.mixed(frame(spark, data).repartition(6)).collect()
    assert len(got) == len(data)
    size = lambda t: len((t or "").split())
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _ in data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert 0 <= r.copies <= 3
        expected = r.target / r.source_size if r.source_size else 0
        assert int(expected) <= r.copies <= int(expected) + 1
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s, target in want.items():  # in order of size, the error is within the largest document
        assert abs(taken[s] - target) <= largest[s]
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.15)


def test_reruns_agree(spark):
    data = rows()
    key = lambda df: sorted((str(r.doc_id), r.text_hash, r.copies) for r in mixing.mixed(df).collect())
    assert key(frame(spark, data)) == key(frame(spark, data[::-1]).repartition(11))


def test_rows_are_repeated_as_often_as_taken(spark):
    data = rows()
    df = frame(spark, data)
    out = mixing.resampled(df)
    assert out.columns == df.columns
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mixed(df).collect():
        want[str(r.doc_id)] += r.copies
    for r in out.collect():
        got[str(r.doc_id)] += 1
        assert r.size == "clash"
    assert got == {k: v for k, v in want.items() if v}


def test_degenerate_tables(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.resampled(frame(spark, [])).count() == 0
    for r in mixing.mixed(frame(spark, [(1, None, None), (2, "", "a")])).collect():
        assert (r.target, r.copies, r.source_size) == (0.0, 0, 0)
    one = mixing.mixed(frame(spark, [(1, "a b c", "s"), (2, "d", "s")])).collect()
    assert {(r.doc_id, r.copies, r.target) for r in one} == {(1, 1, 4.0), (2, 1, 4.0)}


def test_columns_of_any_name_and_repeated_rows(spark):
    """Names that the work itself uses stay the user's."""
    names = ["doc_id", "text", "source", "__id", "__own", "id", "hash", "row", "n", "copies", "a.b"]
    data = [(i, "x y z", "s", *("keep",) * 8) for i in [1, 2, 3, 3, 3, 3]] + [(None, None, None, *("keep",) * 8)]
    df = spark.createDataFrame(data, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    out = mixing.resampled(df).collect()
    assert out and all(list(r.asDict()) == names and set(r[3:]) == {"keep"} for r in out)
    taken = sum(r.copies * r.size for r in mixing.mixed(df).collect())
    assert 3 * len(out) == taken
