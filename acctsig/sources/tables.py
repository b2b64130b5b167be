"""Sources and keys.

Two input layouts:

* the original one: one JSON document per dataset
  ``{lang, users: [...], posts: [...]}`` (``read_dataset_json``), plus one
  label file of account ids per dataset (``read_labels``);
* the scale layout: flat ``accounts`` / ``posts`` tables (Parquet, JSON
  lines) with a ``dataset_id`` column, ideally partitioned by it
  (``read_flat``). A multi-line JSON document is one task, so large inputs
  should be converted once (``convert_json_to_parquet``).

Every downstream operator works on the flat form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.functions import patterns as P
from acctsig.functions.text import WS_CHARS

KEYS = ("dataset_id", "author_id")

USER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("tweet_count", T.LongType()),
    T.StructField("z_score", T.DoubleType()),
])
POST_SCHEMA = T.StructType([
    T.StructField("author_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_at", T.StringType()),
])
DOCUMENT_SCHEMA = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("users", T.ArrayType(USER_SCHEMA)),
    T.StructField("posts", T.ArrayType(POST_SCHEMA)),
])


def parse_created_at(col: F.Column) -> tuple[F.Column, F.Column]:
    """ISO-8601 string -> (instant, hour of the local wall clock).

    'Z' means +00:00. Date and time may be set apart by 'T' or a blank, and
    a date alone is its midnight. A string without an offset is in UTC. The
    hour is read from the string itself, so it is the hour in the timestamp's
    own offset; neither depends on the session's time zone.
    """
    s = F.regexp_replace(col, "Z$", "+00:00")
    own = F.regexp_extract(s, r"[T ](\d{2})(?::|$)", 1)
    hour = F.when(s.isNotNull(), F.coalesce(F.nullif(own, F.lit("")).cast("int"), F.lit(0)))
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    s = F.when(s.rlike(r"[+-]\d{2}:?\d{2}(:?\d{2})?$") & s.rlike("[T ]"), s).otherwise(F.concat(s, F.lit("+00:00")))
    return F.to_timestamp(s), hour


def read_dataset_json(spark: SparkSession, path: str, dataset_id: int | None = None,
                      default_lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """One (or many) dataset documents -> (accounts, posts).

    ``dataset_id`` defaults to a hash of the file name; ``lang`` falls back
    to ``default_lang``. Account order and post order (``post_seq``) are the
    positions in the document.
    """
    doc = (spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
           .withColumn("_file", F.input_file_name()))
    ds = (F.lit(dataset_id).cast("long") if dataset_id is not None
          else F.xxhash64("_file"))
    doc = doc.select(ds.alias("dataset_id"),
                     F.coalesce("lang", F.lit(default_lang)).alias("lang"), "users", "posts")
    accounts = doc.select("dataset_id", "lang", F.posexplode("users").alias("pos", "u")) \
        .select("dataset_id", "lang", "pos", "u.*")
    posts = doc.select("dataset_id", "lang", F.posexplode("posts").alias("post_seq", "p")) \
        .select("dataset_id", "lang", F.col("post_seq").cast("long"), "p.*")
    ts, hour = parse_created_at(F.col("created_at"))
    posts = posts.select("dataset_id", "post_seq", "author_id", ts.alias("created_at"),
                         hour.alias("hour_local"), "lang", "text")
    return dedupe_accounts(accounts), posts


def read_flat(spark: SparkSession, accounts_path: str, posts_path: str,
              fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Scale layout: flat account and post tables; repeated account ids are reduced to one row."""
    r = spark.read.format(fmt)
    return unique_accounts(r.load(accounts_path)), r.load(posts_path)


def unique_accounts(accounts: DataFrame, id_col: str = "id", keys=KEYS) -> DataFrame:
    """One row per account of a flat table: of repeated ids the row that is largest, column by column.

    A flat table has no order, so there is no later row to prefer.
    """
    rest = sorted(set(accounts.columns) - {keys[0], id_col})
    w = Window.partitionBy(keys[0], id_col).orderBy(*([F.col(f"`{c}`").desc_nulls_last() for c in rest] or [F.lit(1)]))
    return (accounts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .drop("_r"))


def convert_json_to_parquet(spark: SparkSession, json_path: str, out_dir: str,
                            dataset_id: int | None = None) -> None:
    """One-off conversion of JSON documents to partitioned Parquet tables."""
    acc, posts = read_dataset_json(spark, json_path, dataset_id)
    acc.write.mode("overwrite").partitionBy("dataset_id").parquet(f"{out_dir}/accounts")
    posts.write.mode("overwrite").partitionBy("dataset_id").parquet(f"{out_dir}/posts")


def read_labels(spark: SparkSession, path: str, dataset_id: int | None = None) -> DataFrame:
    """Label file(s) -> distinct (dataset_id, author_id); lines are
    stripped and blank lines dropped."""
    t = spark.read.text(path).withColumn("_file", F.input_file_name())
    ds = F.lit(dataset_id).cast("long") if dataset_id is not None else \
        F.regexp_extract("_file", r"\.(\d+)\.txt$", 1).cast("long")
    v = F.trim("value", F.lit(WS_CHARS))
    return (t.select(ds.alias("dataset_id"), v.alias("author_id"))
            .where(F.length("author_id") > 0).distinct())


def practice_corpus(spark: SparkSession, base_dir: str,
                    ids_to_lang: dict[int, str] = P.PRACTICE_LANG):
    """S3: practice datasets that have both a document and a label file.

    Returns (accounts, posts, labels) unioned over the datasets found, with
    the fixed dataset -> language map applied.
    """
    accs, posts, labels = [], [], []
    for ds, lang in ids_to_lang.items():
        data = f"{base_dir}/dataset.posts&users.{ds}.json"
        bots = f"{base_dir}/dataset.bots.{ds}.txt"
        if not (exists(spark, data) and exists(spark, bots)):
            continue
        a, p = read_dataset_json(spark, data, ds)
        accs.append(a.withColumn("lang", F.lit(lang)))
        posts.append(p.withColumn("lang", F.lit(lang)))
        labels.append(read_labels(spark, bots, ds))
    if not accs:
        return None, None, None
    return union_all(accs), union_all(posts), union_all(labels)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Stack per-dataset tables."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def dedupe_accounts(accounts: DataFrame, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """A later duplicate account id wins."""
    w = Window.partitionBy("dataset_id", id_col).orderBy(F.desc(pos_col))
    return (accounts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .drop("_r"))


def eligible_posts(posts: DataFrame, accounts: DataFrame, id_col: str = "id",
                   keys=KEYS) -> DataFrame:
    """Posts whose author is a known account (left semi join)."""
    ids = accounts.select(F.col(keys[0]), F.col(id_col).alias(keys[1]))
    return posts.join(ids, list(keys), "left_semi")


def eligible_accounts(accounts: DataFrame, posts: DataFrame, id_col: str = "id",
                      keys=KEYS) -> DataFrame:
    """Accounts with at least one post, with their post count.

    The count is pre-aggregated per author before the join, so the join
    carries one row per author.
    """
    n = posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_posts")) \
        .withColumnRenamed(keys[1], id_col)
    return accounts.join(n, [keys[0], id_col])


def route_language(lang: F.Column, available: list[str], fallback: str = "en") -> F.Column:
    """The dataset language if a model exists for it, else ``fallback``."""
    return F.when(lang.isin(*available), lang).otherwise(F.lit(fallback))


def run_summary(accounts: DataFrame, detections: DataFrame, keys=KEYS) -> DataFrame:
    """Users, detections, model hits, rule hits, rule-only hits per dataset."""
    ds = keys[0]
    users = accounts.groupBy(ds).agg(F.count(F.lit(1)).alias("users"))
    d = detections.groupBy(ds).agg(
        F.count(F.lit(1)).alias("detected"),
        F.count_if("model_hit").alias("model_hits"),
        F.count_if("rule_hit").alias("rule_hits"),
        F.count_if(F.col("rule_hit") & ~F.col("model_hit")).alias("rule_only"))
    return users.join(d, ds, "left").na.fill(0)
