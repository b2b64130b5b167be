"""End to end: features -> per-language ensembles -> detection union."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from acctsig.plans import job
from acctsig.sources import tables as src

TINY = {"iters": (2, 2, 2), "step": 0.3}


def test_detect_end_to_end(spark):
    accounts, posts, labels = [], [], []
    base = datetime(2024, 1, 1)
    seq = 0
    for ds, lang in ((30, "en"), (31, "fr")):
        for a in range(24):
            bot = a % 3 == 0
            name = "Bot\x01" if a == 3 else f"User {a}"
            accounts.append((ds, a, name, f"u{a}", "d", "x", None, 0.0))
            for k in range(6):
                text = ("Click https://t.co/x DM me #Love" if bot else f"plain words number {k} here")
                if a == 6 and k == 0:
                    text = "here are some of my recent tweets"
                posts.append((ds, seq, a, base + timedelta(minutes=seq * (1 if bot else 37)), lang, text))
                seq += 1
            if bot:
                labels.append((ds, a))
    A = spark.createDataFrame(accounts, "dataset_id long, id long, name string, username string, "
                                        "description string, location string, tweet_count long, "
                                        "z_score double")
    Pst = spark.createDataFrame(posts, "dataset_id long, post_seq long, author_id long, "
                                       "created_at timestamp_ntz, lang string, text string")
    L = spark.createDataFrame(labels, "dataset_id long, author_id long")
    fm = job.features_with_lang(spark, A, Pst, L).cache()
    models = {lg: e for lg, (e, _) in job.train_by_language(spark, fm, TINY).items()}
    assert set(models) == {"en", "fr"}
    # an unknown language is routed to 'en' before feature extraction
    P2 = Pst.withColumn("lang", F.when(F.col("dataset_id") == 31, "de").otherwise(F.col("lang")))
    P2 = P2.withColumn("lang", src.route_language(F.col("lang"), list(models)))
    fm2 = job.features_with_lang(spark, A, P2, None, with_rules=True).cache()
    det_df = job.detect(spark, fm2, models).cache()
    det = {(r["dataset_id"], r["author_id"]): r for r in det_df.collect()}
    assert det[(30, 3)]["rule_hit"] and det[(30, 6)]["rule_hit"]      # garbled name, leak
    bots = {(ds, a) for ds, a in labels}
    hits = {k for k, r in det.items() if r["model_hit"]}
    assert len(hits & bots) >= len(bots) // 2                          # planted signal found
    summ = src.run_summary(A, det_df).collect()
    assert {r["dataset_id"] for r in summ} == {30, 31}


def corpus(tmp_path, ds, lang, n=12):
    """A dataset document with UUID ids and its label file."""
    import json
    import uuid
    ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{ds}/{a}")) for a in range(n)]
    users = [{"id": u, "name": "Bot\x01" if a == 0 else f"User {a}", "username": f"u{a}", "location": "x"}
             for a, u in enumerate(ids)]
    posts = [{"author_id": u, "created_at": f"2024-03-10T0{k}:{a:02d}:00+02:00",
              "text": "Click https://t.co/x DM me #Love" if a % 3 == 0 else f"plain words number {k} and {a} here"}
             for a, u in enumerate(ids) for k in range(4)]
    doc = tmp_path / f"dataset.posts&users.{ds}.json"
    doc.write_text(json.dumps({"lang": lang, "users": users, "posts": posts}))
    (tmp_path / f"dataset.bots.{ds}.txt").write_text("\n".join(u for a, u in enumerate(ids) if a % 3 == 0))
    return str(doc), ids


def test_jobs_from_json_documents(spark, tmp_path):
    """Train (as there is no model), detect and report, from documents with UUID ids."""
    import pytest
    for ds, lang in ((31, "fr"), (30, "en")):
        doc, ids = corpus(tmp_path, ds, lang)
    accounts, posts = src.read_dataset_json(spark, doc, 30)
    models, out = str(tmp_path / "models"), str(tmp_path / "out")
    with pytest.raises(ValueError, match="no model"):
        job.detect_job(spark, accounts, posts, models, out)
    job.detect_job(spark, accounts, posts, models, out, str(tmp_path), TINY)
    found = spark.read.text(f"{out}/ids")
    assert {r["dataset_id"] for r in found.collect()} == {30}
    assert ids[0] in {r["value"] for r in found.collect()}           # the garbled name
    assert set(job.load_models(spark, models)) == {"en", "fr"}
    tables = job.report_job(spark, accounts, models, out)
    assert tables["importance"].count() == 2 * 15
    assert tables["training"].count() == 2
    assert tables["histogram"].count() == 2 * 2 * 30
    assert tables["detections"].first()["accounts"] == 12
    assert "cross" not in tables and job.cross_pairs(spark.createDataFrame(
        [(30, "en"), (31, "fr"), (32, "en"), (35, "en")], "dataset_id long, lang string")) == [(30, 32, "en"), (32, 30, "en")]
    # the hour is that of the post's own offset
    fm = job.features_with_lang(spark, accounts, posts, None)
    assert {r["night_ratio"] for r in fm.collect()} == {1.0}

    # A model for French alone: an English dataset has no model to go to, and says so.
    french = {"fr": job.load_models(spark, models)["fr"]}
    rules = job.features_with_lang(spark, accounts, posts, None, with_rules=True)
    with pytest.raises(ValueError, match="no model for en"):
        job.detect(spark, rules, french)
    # With that model as the fallback nothing is lost: all rule hits are there.
    det = job.detect(spark, rules, french, fallback="fr").collect()
    assert ids[0] in {r["author_id"] for r in det if r["rule_hit"]}


def test_a_job_needs_a_shared_folder(spark):
    import pytest
    from acctsig.session import require_checkpoint_dir

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        require_checkpoint_dir(Unset)
    assert require_checkpoint_dir(spark)


def test_flat_accounts_are_unique(spark, tmp_path):
    rows = [(30, "a", "x"), (30, "a", "y"), (30, "a", None), (31, "a", "x")]
    spark.createDataFrame(rows, "dataset_id long, id string, name string").write.parquet(str(tmp_path / "a"))
    acc, _ = src.read_flat(spark, str(tmp_path / "a"), str(tmp_path / "a"))
    assert sorted((r["dataset_id"], r["name"]) for r in acc.collect()) == [(30, "y"), (31, "x")]
