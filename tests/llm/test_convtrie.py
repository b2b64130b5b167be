"""The conversation trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from acctsig.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, key string, conv int, depth double"


def ordered(rows):
    """Turns of each conversation in order, as (role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[3] for t in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def below(path):
        todo, leaves, saved = [path], 0, 0
        while todo:
            p = todo.pop()
            leaves += not kids[p]
            saved += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
            todo += kids[p]
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(4 * n), n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            same = rng.random() < 0.8
            rows.append((c, t, rng.choice(["user", "bot"]) if not same else "user",
                         f"turn {t}é😀" if same else rng.choice(["x", "", "y" * 50]), "k", 1, 0.5))
    return rows


@pytest.mark.parametrize("size", [1, 3, 4])
def test_equals_a_plain_trie(spark, size):
    rows = sample(60, size)
    turns = convtrie.digested(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got(convtrie.trie(turns, size=size)) == plain(ordered(rows))


def test_shared_beginnings(spark):
    rows = sample(150, 9) + [(100, 0, "user", "start", "k", 1, 1.0), (137, 0, "user", "a", None, None, None), (-250, 3, "u", "neg", "", 0, 0.0)]
    turns = convtrie.digested(spark.createDataFrame(rows, SCHEMA))
    want = {c: v for c, v in rebuilt(ordered([r for r in rows if (r[0] or 0) >= 0])).items()}
    found = convtrie.shared_beginnings(turns.filter("conv >= 0"))
    assert got(convtrie.trie(turns.filter("conv >= 0"), found)) == plain(want)
    assert any(not v for v in want.values())  # turnless ones are members of the root


def test_hot_groups_and_a_deep_conversation(spark):
    """A third are copies, all share the first turns, one has 150 turns: lookups split their hot keys, sums double eight times."""
    rows = [(c, t, "u", f"t{t}" if c % 3 == 0 or t < 2 else f"{c} {t}", "", 0, 0.0) for c in range(90) for t in range(6)]
    rows += [(1000, t, "u", f"t{t}", "", 0, 0.0) for t in range(150)]
    turns = convtrie.digested(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got(convtrie.trie(turns)) == plain(ordered(rows))


def test_odd_rows(spark):
    rows = [(1, None, "user", "a", "", 0, 0.0), (1, 0, None, "b", "", 0, 0.0), (1, 0, "", "c", "", 0, 0.0), (1, 0, "", "c", "", 0, 0.0),
            (2, 5, None, None, None, None, None), (3, 1, "1:", "x", "", 0, 0.0), (4, 1, "1", ":x", "", 0, 0.0),
            (None, 1, "user", "lost", "", 0, 0.0), (5, None, "user", "a" * 300_000, "", 0, 0.0)]
    turns = convtrie.digested(spark.createDataFrame(rows, SCHEMA))
    assert got(convtrie.trie(turns)) == plain(ordered(rows))
    empty = convtrie.digested(spark.createDataFrame([], SCHEMA))
    assert got(convtrie.trie(empty)) == []
    assert got(convtrie.trie(empty, convtrie.shared_beginnings(empty))) == []


def test_ends_are_hashed_in_numeric_order_over_many_batches(spark):
    ids = random.Random(3).sample(range(10 ** 9), 30_000)
    ends = spark.createDataFrame([("k" if i % 3 else "m", i) for i in ids], "key string, conv long").repartition(9)
    want = {k: hashlib.sha256(",".join(str(i) for i in sorted(ids) if (i % 3 != 0) == (k == "k")).encode()).hexdigest() for k in "km"}
    assert {r.key: r.ends_sha256 for r in convtrie.end_digests(ends).collect()} == want
