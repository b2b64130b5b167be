"""Scoring operators: golden confusion rows, sweep = naive passes, folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctsig.operators import evaluate as ev
from acctsig.operators import learn as ml


def test_sweep_values_are_numpy_arange():
    assert ev.sweep_thresholds() == list(np.arange(0.10, 0.95, 0.01))


@pytest.mark.parametrize("tp,fn,fp,score", [(54, 9, 4, 199), (64, 2, 9, 236),
                                            (26, 2, 0, 102), (27, 0, 0, 108)])
def test_golden_confusion(spark, tp, fn, fp, score):
    rows = ([(1, 1)] * tp + [(1, 0)] * fn + [(0, 1)] * fp + [(0, 0)] * 50)
    df = spark.createDataFrame(rows, "label int, prediction int")
    c = ev.confusion(df).first()
    assert (c["tp"], c["fn"], c["fp"], c["tn"], c["score"]) == (tp, fn, fp, 50, score)
    assert c["precision"] == pytest.approx(tp / (tp + fp))
    assert c["recall"] == pytest.approx(tp / (tp + fn))


# Five positives and five negatives, at and between the sweep's values.
POSITIVE = [0.05, 0.30, 0.50, 0.505, 0.94]
NEGATIVE = [0.00, 0.10, 0.29, 0.505, 1.00]
# Threshold index: positives and negatives that reach it, counted by hand.
REACHED = {0: (4, 4), 1: (4, 3), 19: (4, 3), 20: (4, 2), 21: (3, 2), 40: (3, 2), 41: (1, 1), 84: (1, 1)}


def test_sweep_counts(spark):
    df = spark.createDataFrame([(1, p) for p in POSITIVE] + [(0, p) for p in NEGATIVE], "label int, probability double")
    sw = {r["idx"]: r for r in ev.threshold_sweep(df).collect()}
    assert sorted(sw) == list(range(85))
    # 0.10 + 20 steps is 0.30000000000000004 and 0.10 + 40 steps 0.5 exactly, as numpy has them
    exact = ev.sweep_thresholds()
    for i, (tp, fp) in REACHED.items():
        tp -= sum(p < exact[i] <= p + 1e-9 for p in POSITIVE)
        assert (sw[i]["tp"], sw[i]["fp"], sw[i]["fn"], sw[i]["tn"]) == (tp, fp, 5 - tp, 5 - fp), i
        assert sw[i]["score"] == 4 * tp - (5 - tp) - 2 * fp


@pytest.mark.parametrize("rows,idx,score", [
    ([(1, 0.2), (1, 0.3), (0, 0.1), (0, 0.15)], 6, 8),     # the first value above 0.15 already has the best score
    ([(0, 0.5)] * 10, 41, 0),                              # no positives: the first value that none reaches
    ([(1, 0.05)], 0, -1),                                  # never reached: all values tie, the first is taken
    ([(1, 1.0), (0, 1.0), (0, 1.0)], 0, 0),                # always reached
])
def test_best_threshold_is_the_first(spark, rows, idx, score):
    df = spark.createDataFrame(rows, "label int, probability double")
    b = ev.best_threshold(ev.threshold_sweep(df)).first()
    assert (b["idx"], b["score"]) == (idx, score)
    assert b["threshold"] == ev.sweep_thresholds()[idx]


def test_folds_stratified_and_equal_to_global_rank(spark):
    rows = [(30, i, int(i % 7 == 0)) for i in range(203)]
    df = spark.createDataFrame(rows, "dataset_id long, author_id long, label int")
    f = ml.stratified_folds(df, 5, 42).collect()
    by = {}
    for r in f:
        by.setdefault((r["label"], r["fold"]), 0)
        by[(r["label"], r["fold"])] += 1
    for lab in (0, 1):
        sizes = [by.get((lab, k), 0) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    w = F.row_number().over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("label").orderBy(
            F.md5(F.concat_ws("|", F.lit("42"), F.col("dataset_id").cast("string"),
                              F.col("author_id").cast("string"))), "dataset_id", "author_id"))
    g = {r["author_id"]: (r["rn"] - 1) % 5 for r in df.withColumn("rn", w).collect()}
    assert all(g[r["author_id"]] == r["fold"] for r in f)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_counts_are_numpy_s(spark, seed):
    """Scores with two decimals often lie on an edge; empty bins have rows."""
    rnd = random.Random(seed)
    rows = [(int(rnd.random() < 0.4), rnd.randint(0, 100) / 100) for _ in range(300)] + [(2, 0.7)] * 3
    df = spark.createDataFrame(rows, "label int, probability double")
    h = ev.score_histogram(df).collect()
    assert len(h) == 3 * 30
    for lab in (0, 1, 2):
        hs = sorted((r for r in h if r["label"] == lab), key=lambda r: r["bin"])
        density, edges = np.histogram([p for y, p in rows if y == lab], bins=30, density=True)
        counts, _ = np.histogram([p for y, p in rows if y == lab], bins=30)
        assert [r["count"] for r in hs] == counts.tolist()
        assert [r["bin_lo"] for r in hs] == pytest.approx(edges[:-1].tolist())
        assert [r["density"] for r in hs] == pytest.approx(density.tolist())
