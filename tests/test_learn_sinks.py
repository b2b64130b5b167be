"""Ensemble fit/predict, save/load (S8), detection sink (S7), corpus (S3)."""

import json
import random

from pyspark.sql import functions as F

from acctsig.operators import learn as ml
from acctsig.operators.assemble import FEATURE_COLUMNS, vectorize
from acctsig.plans import job
from acctsig.sources import tables as src

TINY = {"iters": (3, 3, 2), "step": 0.3}


def _features(spark, n=80, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lab = int(i % 4 == 0)
        vals = [rnd.random() + (2.0 if (lab and k < 3) else 0.0) for k in range(len(FEATURE_COLUMNS))]
        rows.append((30, i, lab, *vals))
    cols = ["dataset_id", "author_id", "label"] + FEATURE_COLUMNS
    return spark.createDataFrame(rows, cols)


def test_fit_predict_save_load(spark, tmp_path):
    fm = _features(spark)
    ens, oof = ml.train(spark, fm, TINY, "en", shards=2)
    assert oof.count() == 80
    assert 0.10 <= ens.threshold <= 0.95
    pred = ml.predict(ens, vectorize(fm)).select("author_id", "probability", "prediction")
    acc = pred.join(fm.select("author_id", "label"), "author_id") \
        .agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert acc > 0.9                                    # planted signal is learned
    ml.save(ens, str(tmp_path / "models"), spark)
    back = ml.load(str(tmp_path / "models"), "en", spark)
    assert back.threshold == ens.threshold and back.features == ens.features
    p2 = ml.predict(back, vectorize(fm)).select("author_id", F.col("probability").alias("p2"))
    diff = pred.join(p2, "author_id").agg(F.max(F.abs(F.col("probability") - F.col("p2")))).first()[0]
    assert diff < 1e-12
    imp = ml.feature_importance(spark, ens, 5).collect()
    assert len(imp) == 5


def test_the_default_length_is_the_original_one():
    import inspect
    assert ml.REFERENCE == {"iters": (800, 800, 500), "step": 0.03}
    for f in (ml.fit, ml.train, ml.out_of_fold, ml.cross_dataset, job.train_by_language, job.train_job, job.detect_job,
              job.cross_dataset_report):
        assert inspect.signature(f).parameters["preset"].default is ml.REFERENCE


def test_detection_sink_sorted(spark, tmp_path):
    det = spark.createDataFrame([(30, 3), (30, 1), (31, 2)], "dataset_id long, author_id long")
    job.write_detections(det, str(tmp_path / "out"))
    lines = (tmp_path / "out" / "dataset_id=30").glob("part-*")
    got = [ln for f in sorted(lines) for ln in f.read_text().splitlines()]
    assert got == ["1", "3"]


def test_practice_corpus_discovery(spark, tmp_path):
    for ds in (30, 31):
        (tmp_path / f"dataset.posts&users.{ds}.json").write_text(json.dumps(
            {"lang": "xx", "users": [{"id": f"a{ds}"}],
             "posts": [{"author_id": f"a{ds}", "text": "t", "created_at": "2024-01-01T00:00:00Z"}]}))
    (tmp_path / "dataset.bots.30.txt").write_text(f"a30\n")   # 31 has no label file
    acc, posts, labels = src.practice_corpus(spark, str(tmp_path))
    assert {r["dataset_id"] for r in acc.collect()} == {30}
    assert {r["lang"] for r in posts.collect()} == {"en"}
    assert [r["author_id"] for r in labels.collect()] == ["a30"]
