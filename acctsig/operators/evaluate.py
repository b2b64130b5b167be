"""Scoring and evaluation (E1–E7), all as aggregations.

The threshold sweep is one pass over the scored rows: each row counts how
many sweep thresholds it reaches (``p >= t``), rows are grouped by that
count (at most 86 groups), and each group is spread over the threshold
indices it reaches, giving TP/FP/FN/TN for every threshold at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsig.functions import patterns as P
from acctsig.functions.sizes import small


def sweep_thresholds(start: float = P.SWEEP_START, step: float = P.SWEEP_STEP,
                     count: int = P.SWEEP_COUNT) -> list[float]:
    """The sweep values exactly as numpy's ``arange(0.10, 0.95, 0.01)``:
    ``start + i * ((start + step) - start)`` in doubles."""
    delta = (start + step) - start
    return [start + i * delta for i in range(count)]


def score_expr(tp: Column, fn: Column, fp: Column) -> Column:
    return F.lit(P.SCORE_TP) * tp + F.lit(P.SCORE_FN) * fn + F.lit(P.SCORE_FP) * fp


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction",
              by: list[str] | None = None) -> DataFrame:
    """E1 + E3: TP, FN, FP, TN, score, precision, recall, accuracy."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    a = df.groupBy(*(by or [])).agg(
        F.count_if(p & y).alias("tp"), F.count_if(~p & y).alias("fn"),
        F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return a.select(
        "*", score_expr(tp, fn, fp).alias("score"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"),
        (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"),
        ((tp + tn) / F.greatest(tp + fn + fp + tn, F.lit(1))).alias("accuracy"),
        (F.lit(P.SCORE_TP) * (tp + fn)).alias("max_score"))


def threshold_sweep(df: DataFrame, label: str = "label", prob: str = "probability",
                    by: list[str] | None = None,
                    thresholds: list[float] | None = None) -> DataFrame:
    """(by..., idx, threshold, score, tp, fn, fp, tn) for every threshold.

    A row is predicted positive at index i when it reaches more than i
    thresholds. Rows are first counted per (group, reach) — at most 86
    rows per group — and each of those rows is spread over the indices it
    reaches, so the work after the first aggregation is bounded by the
    number of thresholds, not by the data.
    """
    ts = thresholds or sweep_thresholds()
    by = by or []
    arr = F.array(*[F.lit(t) for t in ts])
    reach = F.size(F.filter(arr, lambda t: F.col(prob) >= t))
    g = df.groupBy(*by, reach.alias("reach")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    hit = (g.where(F.col("reach") > 0)
           .select(*by, "pos", "neg", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("idx"))
           .groupBy(*by, "idx").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp")))
    tot = g.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = tot.select(*by, "P", "N", F.explode(F.sequence(F.lit(0), F.lit(len(ts) - 1))).alias("idx"))
    out = grid.join(hit, by + ["idx"], "left")
    tp = F.coalesce(F.col("tp"), F.lit(0))
    fp = F.coalesce(F.col("fp"), F.lit(0))
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return out.select(*by, "idx", F.element_at(arr, F.col("idx") + 1).alias("threshold"),
                      score_expr(tp, fn, fp).alias("score"),
                      tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"))


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first threshold with the highest score (strict improvement)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("idx"))
    return sweep.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def score_histogram(df: DataFrame, prob: str = "probability", label: str = "label",
                    bins: int = P.HISTOGRAM_BINS, by: list[str] | None = None) -> DataFrame:
    """E5: per class, ``bins`` equal bins over the class's own min..max,
    density-normalised (count / (n * width)); a constant class gets the
    range (v - 0.5, v + 0.5) as numpy does.

    The bin edges are lo + i * ((hi - lo) / bins), the last one hi, and a
    score belongs to the last edge that it reaches (the top edge to the last
    bin). Every bin has a row. Scores are first counted per group and value
    of the estimated bin, put right against the edges themselves.
    """
    by = by or []
    keys = by + [label]
    st = df.groupBy(*keys).agg(F.min(prob).alias("lo"), F.max(prob).alias("hi"),
                               F.count(F.lit(1)).alias("n"))
    flat = F.col("lo") == F.col("hi")
    st = st.select(*keys, "n",
                   F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                   F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * width)

    x, top = F.col(prob), F.lit(bins - 1)
    guess = F.least(F.floor((x - F.col("lo")) / width), top).cast("int")
    put_right = (F.when(x < edge(guess), guess - 1)
                 .when((x >= edge(guess + 1)) & (guess < top), guess + 1).otherwise(guess))
    h = (df.join(small(st), keys).select(*keys, put_right.alias("bin"))
         .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = st.withColumn("bin", F.explode(F.sequence(F.lit(0), top)))
    count = F.coalesce(F.col("count"), F.lit(0).cast("long"))
    return grid.join(h, keys + ["bin"], "left").select(
        *keys, "bin", count.alias("count"), edge(F.col("bin")).alias("bin_lo"),
        (count / (F.col("n") * width)).alias("density"))


def detection_summary(detections: DataFrame, accounts: DataFrame,
                      ds: str = "dataset_id") -> DataFrame:
    """Automated vs human accounts per dataset."""
    n = accounts.groupBy(ds).agg(F.count(F.lit(1)).alias("accounts"))
    d = detections.groupBy(ds).agg(F.count(F.lit(1)).alias("automated"))
    return n.join(d, ds, "left").select(ds, "accounts",
                                        F.coalesce("automated", F.lit(0)).alias("automated"),
                                        (F.col("accounts") - F.coalesce("automated", F.lit(0)))
                                        .alias("human"))


def share_of_max(score: Column, positives: Column) -> Column:
    """Score / (4 * positives)."""
    return score / (F.lit(P.SCORE_TP) * F.greatest(positives, F.lit(1)))
