"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsig.llm import (backoff, convtrie, decontam, langid, mixing, permindex, pii, simhash, tokenbin, tokencount,
                         urlfilter, warc, whiten)
from acctsig.llm.common import fold, scratch, table

URL_RULES = [  # host, path, verdict
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
COUNT_LIMIT = 512


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through ARC and WARC archives, as a reader of the latter finds them."""
    found = warc.archive(table(spark, sf_dir, "pages"), scratch(spark, "arc"), scratch(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return (urlfilter.judged(pages, urlfilter.rule_table(spark, URL_RULES))
            .select("page_id", "host", "path", "rule", "verdict"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token-id shards, read back."""
    path = scratch(spark, "shards")
    tokenbin.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return tokenbin.with_starts(tokenbin.read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a backoff model of the training fold."""
    s = backoff.scored(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return s.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score")


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, through a cache that starts empty in each run."""
    n = tokencount.counted(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                           scratch(spark, "token-counts"))
    return n.withColumn("over_limit", F.col("n_tokens") > COUNT_LIMIT)


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item of which it holds a passage."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    m = mixing.mixed(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three folds of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = langid.learned(docs.filter(~held_out))
    return (langid.predicted(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return permindex.searched(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 leading components, whitened."""
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts and the digest are those of the base spans."""
    docs = table(spark, sf_dir, "documents")
    spans = pii.found(docs, pii.learned(docs))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.number(base, k).alias(f"n_{k}") for k in pii.KINDS]
    return spans.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the conversations, with beginnings shared by hundreds of ids."""
    turns = convtrie.digested(table(spark, sf_dir, "conversations"))
    return convtrie.trie(turns, convtrie.shared_beginnings(turns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_warc, op3_urls, op4_tokens, op5_lm, op6_counts, op7_leaks,
                                   op8_mix, op9_language, op10_neighbours, op11_whiten, op12_pii, op13_trie, pipeline)}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM g""",
    "op3_urls": rf"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULES}),
rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM split),
best AS (
  SELECT u.host, u.path, arg_max(r_host || r_path, length(r_host) + length(r_path)) AS rule,
         arg_max(r_verdict, length(r_host) + length(r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules
    ON (u.host = r_host OR ends_with(u.host, '.' || r_host)) AND starts_with(u.path, r_path)
  GROUP BY u.host, u.path)
SELECT page_id, urls.host, urls.path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN best ON urls.host = best.host AND urls.path = best.path""",
    "op8_mix": rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS nth
  FROM d GROUP BY source),
w AS (SELECT *, nth % 3 + 1 AS weight, 3 * source_size AS stop FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(stop) OVER (ORDER BY stop / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY stop / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
            AS level
  FROM w),
t AS (
  SELECT source, source_size,
         least(weight * coalesce((SELECT level FROM levels WHERE weight * level <= stop
                                  ORDER BY stop / weight, nth LIMIT 1), 0.0), CAST(stop AS DOUBLE)) AS target,
         CAST(('0x' || substr(md5('{mixing.SEED}|' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0 AS offs
  FROM levels),
placed AS (
  SELECT d.*, source_size, target, offs, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, digest, doc_id) - 1 AS nth
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(offs + (nth + 1) * rate) - floor(offs + nth * rate)) * size AS BIGINT) AS taken
FROM placed""",
    "op13_trie": r"""
WITH t AS (
  SELECT conv_id AS c, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
         length(coalesce(text, '')) AS len, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, len, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM t),
ids AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
           list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)),
           lambda a, x: list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                                    lambda u, z: xor(u >> 1, (u & 1) * 3988292384::UBIGINT))),
         4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM o)),
turns AS (
  SELECT ids.c, 0 AS part, o.p, o.k, o.len FROM ids JOIN o ON o.c = base AND o.p <= h
  UNION ALL SELECT o.c, 1, o.p, o.k, o.len FROM ids JOIN o ON o.c = ids.c AND o.p > h),
paths AS (
  SELECT ids.c, coalesce(list(k ORDER BY part, p) FILTER (k IS NOT NULL), []) AS ks,
         coalesce(list(len ORDER BY part, p) FILTER (k IS NOT NULL), []) AS lens
  FROM ids LEFT JOIN turns ON turns.c = ids.c GROUP BY ids.c),
steps AS (
  SELECT c, d, CAST(len(ks) AS BIGINT) AS whole, md5(array_to_string(ks[1:d], '')) AS node,
         CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], '')) END AS parent, ks,
         CASE WHEN d > 0 THEN lens[d] ELSE 0 END AS last_len
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(last_len) AS own, any_value(ks) AS ks,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (whole = d), '')) AS ends_sha256
  FROM steps GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT above AS node, sum(own) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT own, kids.n IS NULL AS leaf, unnest(list_transform(range(0, depth + 1), lambda e: md5(array_to_string(ks[1:e], '')))) AS above
        FROM nodes LEFT JOIN kids ON kids.node = nodes.node)
  GROUP BY above)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children,
       sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums ON sums.node = x.node LEFT JOIN kids ON kids.node = x.node LEFT JOIN nodes up ON up.node = x.parent""",
}
