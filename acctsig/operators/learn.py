"""Weighted ensemble of three gradient-boosted-tree learners.

The learners are those of ``operators/boost``: a leaf-wise histogram booster
with L1/L2 leaf penalties, a second-order level-wise one with gamma, and a
residual booster with Newton leaves, at the original settings and length
(800/800/500 trees at rate 0.03). All of an ensemble's models (three learners,
each on all rows and without each of five folds) grow together, so training and
its out-of-fold scores are one run over the rows.

What the original leaves to its libraries is fixed here: quantile bins (64, of
all rows that are trained on, the held-out folds' too), row and column draws by
hashes, ties to the first feature and lowest bin. Only probabilities of the
libraries themselves are not reproduced.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acctsig.functions import patterns as P
from acctsig.functions.sizes import small
from acctsig.operators import boost
from acctsig.operators import evaluate as ev
from acctsig.operators.assemble import FEATURE_COLUMNS, vectorize
from acctsig.session import ensure_checkpoint_dir, ship_package

# The original learners' settings.
LEARNERS = [
    boost.Learner("a", "leafwise", trees=800, rate=0.03, depth=4, leaves=15, l1=1.0, l2=5.0, gain=0.01,
                  least_rows=10, least_hessian=1e-3, columns=0.7, seed=42),
    boost.Learner("b", "gamma", trees=800, rate=0.03, depth=4, l1=1.0, l2=5.0, gain=0.1, least_hessian=5.0,
                  rows=0.7, columns=0.7, prior=False, seed=42),
    boost.Learner("c", "residual", trees=500, rate=0.03, depth=3, least_rows=10, rows=0.7, weighted=False, seed=42),
]
REFERENCE = {"iters": (800, 800, 500), "step": 0.03}
FOLDS = 5


@dataclass
class Ensemble:
    """Three fitted learners, the decision threshold and the feature order."""
    models: list[boost.Trees]
    threshold: float = P.DEFAULT_THRESHOLD
    features: list[str] = field(default_factory=lambda: list(FEATURE_COLUMNS))
    weights: tuple[float, ...] = P.BLEND_WEIGHTS
    lang: str = "en"


def class_weights(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """M4: positives, negatives and negatives / max(positives, 1), per group."""
    c = df.groupBy(*(by or [])).agg(F.count_if(F.col(label) == 1).alias("positives"),
                                    F.count_if(F.col(label) != 1).alias("negatives"))
    return c.withColumn("pos_weight", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)))


def class_weight(df: DataFrame, label: str = "label") -> float:
    """M4 of this training split."""
    return float(class_weights(df, label).first()["pos_weight"])


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label",
                     by: list[str] | None = None,
                     id_cols: tuple[str, ...] = ("dataset_id", "author_id"),
                     prefix_digits: int = 3) -> DataFrame:
    """M5: fold = (rank within class by md5(seed|id) - 1) % k.

    The rank is computed without one window per class: rows are split on
    the first hex digits of the hash (a prefix, so order is kept; 3 digits
    = 4096 windows per class), ranked inside each (class, prefix) window,
    and shifted by the number of rows in earlier prefixes (a table of at
    most 16**digits rows per class).
    """
    by = by or []
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))
    part = by + [label]
    d = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, prefix_digits))
    w = Window.partitionBy(*part, "_b").orderBy("_h", *id_cols)
    d = d.withColumn("_r", F.row_number().over(w))
    cnt = d.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(*part, "_b", F.coalesce(F.sum("_c").over(wo), F.lit(0)).alias("_o"))
    return (d.join(small(off), part + ["_b"])
            .withColumn("fold", ((F.col("_o") + F.col("_r") - 1) % k).cast("int"))
            .drop("_h", "_b", "_r", "_o"))


def learners(preset: dict = REFERENCE) -> list[boost.Learner]:
    """The three learners at a preset's lengths and rate."""
    return [replace(x, trees=n, rate=preset["step"]) for x, n in zip(LEARNERS, preset["iters"])]


def boosting_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows as ``boost`` reads them; a label other than 1 is 0, rows without a fold are in none."""
    fold = F.col("fold") if "fold" in df.columns else F.lit(-2)
    return df.select(vector_to_array(features).alias("x"), (F.col("label") == 1).cast("int").alias("label"), fold.alias("fold"),
                     boost.row_key("dataset_id", "author_id").alias("key"))


def fit(train: DataFrame, preset: dict = REFERENCE, lang: str = "en", shards: int | None = None) -> Ensemble:
    """M1–M3, M8: fit the three learners on a vectorised training frame."""
    got = boost.boosted(boosting_rows(train.drop("fold")), learners(preset), shards=shards)
    return Ensemble([got[(x.name, -1)] for x in LEARNERS], lang=lang)


def _probabilities(models: list[boost.Trees]):
    """An expression: the probabilities of all models, from an array of features."""
    @F.pandas_udf("array<double>")
    def scored(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        rows = np.stack(x.to_numpy()).astype(np.float64)
        return pd.Series(list(np.stack([m.probabilities(rows) for m in models], axis=1)))

    return scored


def blend(ens: Ensemble, df: DataFrame, out: str = "probability") -> DataFrame:
    """M7: weighted sum of the learners' P(bot)."""
    ship_package(df.sparkSession)
    name = "_" + "_".join(df.columns)  # in no column's way
    scored = df.withColumn(name, _probabilities(ens.models)(vector_to_array("features")))
    return scored.withColumn(out, blend_columns([F.col(name)[i] for i in range(len(ens.models))], ens.weights)).drop(name)


def blend_columns(cols: list, weights: tuple[float, ...] = P.BLEND_WEIGHTS):
    """Weighted sum of component probabilities, in component order."""
    out = None
    for c, w in zip(cols, weights):
        term = F.lit(w) * c
        out = term if out is None else out + term
    return out


def predict(ens: Ensemble, df: DataFrame) -> DataFrame:
    """M9: probability and prediction = probability >= threshold."""
    b = blend(ens, df)
    return b.withColumn("prediction", (F.col("probability") >= F.lit(ens.threshold)).cast("int"))


def grown(data: DataFrame, preset: dict = REFERENCE, k: int = FOLDS, seed: int = 42, lang: str = "en",
          shards: int | None = None) -> tuple[Ensemble, DataFrame]:
    """M6 and M8 in one run: the ensemble of all rows, and every row scored by the models grown without its fold.

    The scores (the frame's columns but for the features, fold, probability) are written to the checkpoint folder.
    """
    ensure_checkpoint_dir(data.sparkSession)
    folded = stratified_folds(data, k, seed).checkpoint(eager=True)
    got = boost.boosted(boosting_rows(folded), learners(preset), k, shards=shards)
    of = lambda out: Ensemble([got[(x.name, out)] for x in LEARNERS], lang=lang)
    scores = [blend(of(f), folded.where(F.col("fold") == f)).drop("features") for f in range(k)]
    oof = scores[0]
    for s in scores[1:]:
        oof = oof.unionByName(s)
    return of(-1), oof.checkpoint(eager=True)


def out_of_fold(df: DataFrame, preset: dict = REFERENCE, k: int = FOLDS, seed: int = 42, lang: str = "en",
                shards: int | None = None) -> DataFrame:
    """M6: every row scored by learners fitted without its fold."""
    return grown(df, preset, k, seed, lang, shards)[1]


def train(spark: SparkSession, features: DataFrame, preset: dict = REFERENCE, lang: str = "en",
          shards: int | None = None) -> tuple[Ensemble, DataFrame]:
    """Full training: models on all rows, threshold from out-of-fold scores.

    Returns the ensemble and the out-of-fold scores.
    """
    ens, oof = grown(vectorize(features).select("dataset_id", "author_id", "label", "features"), preset, lang=lang, shards=shards)
    best = ev.best_threshold(ev.threshold_sweep(oof)).first()
    if best is not None:  # no rows, no scores
        ens.threshold = float(best["threshold"])
    return ens, oof


def training_report(ens: Ensemble, oof: DataFrame) -> DataFrame:
    """E1, E3 of the out-of-fold scores at the ensemble's threshold, one row."""
    pred = oof.withColumn("prediction", (F.col("probability") >= F.lit(ens.threshold)).cast("int"))
    return ev.confusion(pred).select(F.lit(ens.lang).alias("lang"), F.lit(ens.threshold).alias("threshold"), "*")


def feature_importance(spark: SparkSession, ens: Ensemble, k: int = P.TOP_FEATURES_PRINT, learner: int = 0) -> DataFrame:
    """The k features that learner A splits on most often; ties in feature order, unused features last."""
    name = LEARNERS[learner].name
    counts = boost.split_counts(boost.node_table(spark, {(name, -1): ens.models[learner]}))
    names = spark.createDataFrame(list(enumerate(ens.features)), "i int, name string")
    ranked = names.join(counts, F.col("i") == F.col("feature"), "left").select(
        F.lit(ens.lang).alias("lang"), F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"), "i")
    w = Window.partitionBy("lang").orderBy(F.desc("splits"), F.asc("i"))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("i")


def cross_dataset(spark: SparkSession, features: DataFrame, train_ds: int, test_ds: int,
                  preset: dict = REFERENCE, lang: str = "en", shards: int | None = None) -> DataFrame:
    """Train on one dataset, score another; report both the threshold
    re-optimised on the test labels (as originally reported) and the one
    learned from the training split's out-of-fold scores."""
    ens, _ = train(spark, features.where(F.col("dataset_id") == train_ds), preset, lang, shards)
    scored = blend(ens, vectorize(features.where(F.col("dataset_id") == test_ds))).drop("features").checkpoint(eager=True)
    return cross_report(spark, scored, ens.threshold, train_ds, test_ds, lang)


def cross_report(spark: SparkSession, scored: DataFrame, threshold: float, train_ds: int | None,
                 test_ds: int | None, lang: str) -> DataFrame:
    """E4 from scored test rows: a row for the threshold tuned on them and one for the given threshold."""
    tuned = ev.best_threshold(ev.threshold_sweep(scored)).first()
    rows = []
    for kind, t in (("test_tuned", float(tuned["threshold"])), ("train_oof", threshold)):
        c = ev.confusion(scored.withColumn("prediction",
                                           (F.col("probability") >= F.lit(t)).cast("int"))).first()
        rows.append((train_ds, test_ds, lang, kind, t, int(c["score"]),
                     int(c["max_score"]), int(c["tp"]), int(c["fn"]), int(c["fp"]), int(c["tn"]),
                     float(c["accuracy"]), float(c["precision"]), float(c["recall"])))
    return spark.createDataFrame(rows, "train_ds long, test_ds long, lang string, threshold_kind string, "
                                       "threshold double, score long, max_score long, tp long, "
                                       "fn long, fp long, tn long, accuracy double, "
                                       "precision double, recall double")


def save(ens: Ensemble, path: str, spark: SparkSession) -> None:
    """The learners' trees as a table of nodes plus one metadata row (JSON)."""
    nodes = boost.node_table(spark, {(x.name, -1): m for x, m in zip(LEARNERS, ens.models)})
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/{ens.lang}/trees")
    meta = spark.createDataFrame([(ens.lang, ens.threshold, list(ens.weights), ens.features)],
                                 "lang string, threshold double, weights array<double>, "
                                 "features array<string>")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/{ens.lang}/meta")


def load(path: str, lang: str, spark: SparkSession) -> Ensemble:
    meta = spark.read.json(f"{path}/{lang}/meta").first()
    models = boost.from_nodes(spark.read.parquet(f"{path}/{lang}/trees"))
    return Ensemble([models[(x.name, -1)] for x in LEARNERS], float(meta["threshold"]), list(meta["features"]),
                    tuple(meta["weights"]), lang)
