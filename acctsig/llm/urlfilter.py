"""URL rules by a blocked Bloom filter and an exact hash join (DataFrame functions only).

A rule is a host and a path prefix. A url can only be met by a rule whose
host is the url's host or one of its parent domains, and whose path is one of
the url's path prefixes; with the path lengths that occur in the list, that
is a short array of candidate keys. Each key is hashed to one block of a
Bloom filter (eight 32-bit words, one bit in each), built from the listed
keys by ``bit_or`` per block. The few candidates that pass meet the list in
an exact hash join, which removes the false positives; the longest rule wins.

The verdict depends on host and path alone, so it is found once for each
distinct pair: a url that holds a third of the rows is one row there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
BITS_PER_KEY = 16
# A filter or list up to this many rows (under 100 bytes each) is broadcast, a larger one shuffled.
BROADCAST_ROWS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _slots(key: Column) -> list[Column]:
    """For each word of a block, the one bit that the key sets."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table ``(block, w0 .. w7)`` of at most ``blocks`` rows."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"),
                       *(b.alias(f"w{i}") for i, b in enumerate(_slots(F.col("key")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys ``host path`` of every parent domain and every listed path length.

    A space, which neither a host part nor the list's paths before it hold,
    separates the two.
    """
    labels = F.split(host, "\\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n),
                          lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    prefixes = F.array_distinct(F.filter(
        F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths)),
        lambda p: p.isNotNull()))
    return F.flatten(F.transform(parents, lambda h: F.transform(
        prefixes, lambda p: F.concat(h, F.lit(" "), p))))


def judged(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains
    if the url's path starts with its path. The longest rule (in characters,
    host and path together) wins, then the longest host; of equal rules with
    different verdicts, block. Where none fits, ``rule`` is null and the
    verdict is ``default``: a url that is not listed. Rules with a null part
    are no rules. Null and malformed urls have empty host and path and so
    meet only rules that are empty too. Rows, repeated ones included, and
    columns are kept (clashing columns are replaced). Empty lists and tables
    are fine.
    """
    listed = (rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"),
                           F.col("verdict").alias("r_verdict")).dropna()
              .groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
              .withColumn("key", F.concat("r_host", F.lit(" "), "r_path")))
    of_list = listed.agg(F.count("*"), F.collect_set(F.length("r_path"))).first()
    n, lengths = of_list[0], sorted(of_list[1])
    host, path = host_and_path(F.col(url_col))
    named = urls.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    if not n:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = max(1, -(-n * BITS_PER_KEY // (32 * WORDS)))
    pairs = named.select("host", "path").distinct()
    tried = (pairs.withColumn("key", F.explode(candidates(F.col("host"), F.col("path"), lengths)))
             .withColumn("block", _block(F.col("key"), blocks)))
    hit = reduce(Column.__and__, (F.col(f"w{i}").bitwiseAND(b) != 0
                                  for i, b in enumerate(_slots(F.col("key")))))
    possible = (tried.join(_side(bloom(listed, blocks), blocks), "block")
                .filter(hit).select("host", "path", "key"))
    exact = possible.join(_side(listed, n), "key")
    longest = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
                       F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = (exact.groupBy("host", "path").agg(F.max(longest).alias("best"))
            .select("host", "path", "best.rule", "best.verdict"))
    return (named.join(best, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("verdict", F.lit(default))))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list of ``(host, path, verdict)`` as a table."""
    rows = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
