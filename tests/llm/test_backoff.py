"""The backoff automaton against a direct evaluation of the model's definition."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from acctsig.llm import backoff
from acctsig.llm.common import fold

END = b"\n"


def tokens(t):
    return [*(t or "").encode().lower().split(), END]


class Plain:
    """Counts and probabilities with dictionaries, by recursion over contexts."""

    def __init__(self, texts, order, discount):
        seqs = [[END, *tokens(t)] for t in texts]
        self.uni = Counter(w for s in seqs for w in s[1:])
        self.n, self.v, self.discount = sum(self.uni.values()), len(self.uni), discount
        self.after = {}
        for s in seqs:
            for k in range(2, order + 1):
                for i in range(len(s) - k + 1):
                    self.after.setdefault(tuple(s[i:i + k - 1]), Counter())[s[i + k - 1]] += 1

    def p(self, context, w):
        if not context:
            return (self.uni[w] + 1) / (self.n + self.v + 1)
        if context not in self.after:
            return self.p(context[1:], w)
        c = self.after[context]
        total = sum(c.values())
        return max(c[w] - self.discount, 0) / total + self.discount * len(c) / total * self.p(context[1:], w)

    def score(self, text, order):
        s, total = [END, *tokens(text)], 0.0
        for i in range(1, len(s)):
            total += math.log10(self.p(tuple(s[max(0, i - order + 1):i]), s[i]))
        return total


def corpus():
    rng = random.Random(11)
    common = ["the", "of", "a", "and", "Tree", "sea"]
    word = lambda: rng.choice(common) if rng.random() < 0.7 else f"w{rng.randint(0, 400)}é"
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return [*rows, (200, None), (201, ""), (202, "of the tree " * 3000), rows[3], rows[3], (None, "the sea of w1é"), (None, None)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_the_definition(spark, order):
    rows = corpus()
    how = {"order": order, "discount": 0.6}
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, base double").repartition(5)
    got = backoff.scored(df, fold("doc_id", 7) != 2, **how).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    assert any(held(i) for i, _ in rows)
    model = Plain([t for i, t in rows if not held(i)], order, 0.6)
    want = []
    for i, t in rows:
        tk = tokens(t)
        base = sum(math.log10((model.uni[w] + 1) / (model.n + model.v + 1)) for w in tk)
        want.append((i, not held(i), len(tk), sum(w in model.uni for w in tk), model.n, base, model.score(t, order)))
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got = sorted(((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want.sort(key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_states_sum_to_one():
    model = Plain([t for _, t in corpus()], 3, backoff.DISCOUNT)
    for c in [(), *list(model.after)[::7]]:
        assert sum(model.p(c, w) for w in model.uni) + model.p(c, b"never seen") == pytest.approx(1)


@pytest.mark.parametrize("hot", [1_000, 20, 1])
def test_many_batches_and_shards(spark, monkeypatch, hot):
    """Small batches and shards, contexts dealt by their last word or not: the same scores."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = Plain([t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2], 3, backoff.DISCOUNT)
    monkeypatch.setattr(backoff, "BATCH_TOKENS", 700)
    monkeypatch.setattr(backoff, "SHARD_GRAMS", 2_000)
    got = sorted((len(tokens_of), r.score) for r in backoff.scored(df, fold("doc_id", 7) != 2, hot_share=hot).collect() for tokens_of in [range(r.n_tokens)])
    want = sorted((len(tokens(t)), model.score(t, 3)) for _, t in rows)
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9)


def test_packing():
    import numpy as np
    for cols in ([[1, 2, 3], [4, -5, 6]], [[2**40, 0], [1, -2**50]], [[], []]):
        back = backoff._unpack(backoff._pack(*(np.array(c, dtype=np.int64) for c in cols)), len(cols))
        assert [c.tolist() for c in back] == cols


def test_sorted_rows_as_differences():
    import numpy as np
    rng = np.random.default_rng(2)
    for n in (1, 500):
        rows = np.unique(rng.integers(0, 9, (n, 3)), axis=0)
        cols = list(rows.T)
        assert [c.tolist() for c in backoff._risen(backoff._rising(cols))] == rows.T.tolist()
        shuffled = rng.permutation(rows)
        for big in (1, 2**40):  # sorted as one number, or column by column
            by = backoff._in_order(list(shuffled.T * big))
            assert shuffled[by].tolist() == rows.tolist()
        h = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert backoff._unpack_rising(backoff._pack_rising(h)).tolist() == h.tolist()


def test_frequent_words_have_small_numbers():
    """Word numbers go by falling count, so that n-grams of frequent words pack into few bytes."""
    import numpy as np
    import pyarrow as pa
    h, n = np.arange(1, 6, dtype=np.uint64), np.array([1, 7, 0, 30, 7])
    asked = pa.RecordBatch.from_pylist([{"batch": 4, "k": 1, "shard": 0, "body": backoff._pack(n), "hashes": backoff._pack_rising(h)}])
    (answer,) = backoff._numbered_words(1)([asked])
    numbers, falls = backoff._unpack(answer.to_pylist()[1]["body"], 2)
    assert numbers.tolist() == [3, 1, 4, 0, 2] and np.cumsum(falls).tolist() == [30, 7, 7, 1, 0]


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = backoff.scored(df, F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert backoff.scored(df.limit(0), F.lit(True)).count() == 0


def test_model_beats_its_base_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = backoff.scored(df, fold("doc_id", 7) != 2).filter("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_every_ngram_counts_in_a_large_corpus(spark):
    rows = [*corpus(), (300, "of the tree " * 100_000)]  # one occurrence is a share of about 3e-6
    texts = [t for _, t in rows]
    model = Plain(texts, 3, backoff.DISCOUNT)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in backoff.scored(df, F.lit(True)).collect()}
    for i, t in rows:
        if i is not None and i < 20:
            assert got[i] == pytest.approx(model.score(t, 3), rel=1e-9)


def test_only_the_longest_ngrams_are_sent():
    """Shorter ones are told by those that begin with them: one row per distinct trigram or text end, each in one shard."""
    import numpy as np
    texts = [[0, 2, 3, 2, 3, 0], [0, 2, 3, 1, 0], [0, 0]]
    row = {"train": [True, False, True], "lengths": backoff._pack(np.array([len(t) for t in texts])),
           "numbers": backoff._pack(np.array(sum(texts, []))), "words": backoff._pack(np.array([4, 1, 1, 1]), np.array([900, 5, 4, 3]))}
    dealt = backoff.Dealt(backoff.Batch(row, 3), 1_000, 5, 10)
    got = {}
    for shard, body in dealt.asked():
        hot, *words, n = backoff._unpack(body, 5)
        hot, *words = backoff._risen([hot, *words])
        for *gram, h, m in zip(*(w.tolist() for w in words), hot.tolist(), n.tolist()):
            assert tuple(gram) not in got and h == (2 if gram[:2] == [5, 5] else int(gram[0] == 5))
            got[tuple(gram)] = m
    gid = [5, 6, 7, 8]
    want = Counter()
    for t, train in zip(texts, row["train"]):
        t = [gid[w] for w in t]
        for i in range(len(t) - 1):
            want[tuple([*t[i:i + 3], 0][:3])] += train
    assert got == dict(want)


def test_steps_leave_no_shuffle_files_nor_old_tables(spark):
    import time
    from pathlib import Path

    from acctsig.session import ensure_checkpoint_dir
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    jvm = spark.sparkContext._jvm

    def files():
        every = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {every.apply(i).getName() for i in range(every.size())}

    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    shuffled = files()
    stored, _ = backoff._stored(df.repartition(3, "doc_id"), "trial")
    for _ in range(50):  # they go in the background
        left = [f for f in files() - shuffled if f.startswith("shuffle_") and f.endswith(".data")]
        if not left:
            break
        time.sleep(0.2)
    assert not left and stored.count() == len(corpus())
    assert spark.conf.get(backoff.SHUFFLE_CLEANUP) == "false"  # as it was
    tables = set(folder.iterdir())
    scores = backoff.scored(df, fold("doc_id", 7) != 2)
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - tables) == ["grams", "known"]
    assert scores.count() == len(corpus())
