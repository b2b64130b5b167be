"""What the fixture's plans move: texts are not dealt out by author only to drop unknown authors."""

import datetime as dt

import pytest

from acctsig.plans import catalog
from acctsig.sources import fixture as fx
from acctsig.sources import tables as src


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small driver tables: authors 0 to 6 and null, of which 1 to 4 have accounts; account 2 twice."""
    d = str(tmp_path_factory.mktemp("tables"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put([(i, f"Customer {i}", 0, 1.5 * i, "BUILDING") for i in (1, 2, 2, 3, 4)],
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    put([(0, "FRANCE")], "n_nationkey int, n_name string", "nation")
    put([(1, 1, 10.0), (2, 2, 20.0)], "o_orderkey long, o_custkey long, o_totalprice double", "orders")
    kinds = ["click", "signup", "error", "purchase", "view"]
    events = [(i, dt.datetime(2024, 1, 1 + i % 9, i % 24), i % 7, kinds[i % 5]) for i in range(84)]
    put([*events, events[10], (90, None, None, "click"), (91, dt.datetime(2024, 1, 1), 3, None)],
        "event_id long, ts timestamp, user_id long, event_type string", "events")
    put([(i, None if i == 3 else f"Some text {i} of the thing. The END and NaSA iPhone " * (i + 1), "en", "web") for i in range(6)],
        "doc_id long, text string, lang string, source string", "documents")
    return d


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_eligible_posts_are_those_of_the_operator_on_whole_posts(spark, tables):
    want = src.eligible_posts(fx.posts(spark, tables), fx.accounts(spark, tables))
    got = catalog.fixture_eposts(spark, tables)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    assert got.count() > 0


def test_unknown_authors_are_dropped_before_texts_are_joined(spark, tables):
    lines = plan(catalog.fixture_eposts(spark, tables)).splitlines()
    outer = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x and "doc_id" in x)
    semi = next(i for i, x in enumerate(lines) if "Join LeftSemi" in x)
    assert semi > outer, "\n".join(lines)


def test_word_counts_exchange_a_row_per_account_and_batch(spark):
    from collections import Counter

    from acctsig.functions import wordcounts as wc
    rows = [(1, None, "A b, a\tÉté"), (1, None, None), (1, 7, "x " * 300 + "yy"), (1, 7, "YY x"), (2, 7, ""), (2, 8, "Σας ΑΣ\nb")] * 3
    posts = spark.createDataFrame(rows, "dataset_id long, author_id long, text string").repartition(4)
    df = wc.word_counts(posts, "text", ("dataset_id", "author_id"))
    want = Counter()
    for d, a, t in rows:
        want.update((d, a, wc.TOKEN, w) for w in (t or "").lower().split())
        want.update((d, a, wc.TERM, w) for w in wc._TERMS.findall((t or "").lower()))
    got = df.collect()
    assert len(got) == len(want) and {tuple(r)[:4]: r["n"] for r in got} == dict(want)
    assert "counts" in plan(df) and "Aggregate" not in plan(df)


def test_tfidf_terms_are_counted_again_and_not_kept(spark):
    """The vocabulary's readers get one row of arrays per account, and the length of its weights is 1."""
    from acctsig.operators import similarity as sim
    rows = [(1, "a", "one two two"), (1, "b", "two three one"), (1, "c", "three four"), (1, "a", "three"), (2, "d", "one")]
    posts = spark.createDataFrame(rows, "dataset_id long, author_id string, text string")
    vocab = sim.vocabulary(sim.term_counts(posts), sim.corpus_sizes(posts))
    units = sim.unit_arrays(posts, vocab).collect()
    assert len(units) == len({(r.dataset_id, r.author_id) for r in units}) > 0
    assert all(abs(sum(x * x for x in r.u) - 1) < 1e-12 and len(set(r.idx)) == len(r.idx) for r in units)


def test_first_posts_are_told_before_they_have_texts(spark, tables):
    rows = catalog.fixture_first_eposts(spark, tables, 3).collect()
    every = catalog.fixture_eposts(spark, tables).collect()
    want = {a: sorted(r.post_seq for r in every if r.author_id == a)[:3] for a in {r.author_id for r in every}}
    assert {a: sorted(r.post_seq for r in rows if r.author_id == a) for a in want} == want


def test_character_statistics_look_each_character_up_once():
    import pandas as pd

    from acctsig.functions import charstats as cs
    texts = [None, "", "iPhone NaSAx a\nB!? ÉtÉ 🤖", "  THe lol", "aBcBd eFg"]
    got = cs.stats_frame(pd.Series(texts, dtype=object))
    assert cs.tables()["bits"].dtype.itemsize == 1
    for t, r in zip(texts, got.to_dict("records")):
        t = t or ""
        assert (r["char_len"], r["words"], r["upper"], r["alpha"], r["newline"]) == (
            len(t), len(t.split()), sum(map(str.isupper, t)), sum(map(str.isalpha, t)), t.count("\n"))
    assert got["mid_caps_tokens"].tolist() == [0, 0, 2, 1, 2]
