"""URL rules against a plain loop."""

import random

from pyspark.sql import functions as F

from acctsig.llm import urlfilter
from acctsig.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:n], rest[n:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, rules):
    host, path = split(url)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h) + len(p), len(h), h + p, v))
    return host, path, best[2] if best else None, best[3] if best else "allow"


def urls():
    rng = random.Random(9)
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "notexample.org", "org", "com", "x.com", "é.com", "", ".org", "org."]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/12?x", "/fr/", "/de/#/fr/", "?/fr/", "#/de/", "/fr/\n/x", "//"]
    out = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    return [*out, None, "", "://", "example.org/es/", "http://", "http:// spaced host.org/es/", "x://y://example.org/es/",
            "http://example.org/" + "es/" * 5000, out[0], out[0]]


def test_against_a_loop(spark):
    rows = [(i, u, "clash") for i, u in enumerate(urls())] + [(None, "http://a.org/", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = urlfilter.judged(df, urlfilter.rule_table(spark, URL_RULES)).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(
        ((i, *judge(u, URL_RULES)) for i, u, _ in rows), key=str)


def test_longest_rule_and_ties(spark):
    rules = [("a.b", "/x", "allow"), ("b", "/x/yz", "block"), ("b", "/x", "block"), ("c", "", "allow"), ("c", "", "block"),
             (None, "/", "block"), ("D", "/", "block")]
    df = spark.createDataFrame([("http://a.b/x/yz",), ("http://b/x1",), ("http://c",), ("http://q/",), ("http://d/",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in urlfilter.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {"http://a.b/x/yz": ("b/x/yz", "block"), "http://b/x1": ("b/x", "block"), "http://c": ("c", "block"),
                   "http://q/": (None, "allow"), "http://d/": ("d/", "block")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    urls = spark.createDataFrame([("http://a/",)], "url string")
    assert [(r.rule, r.verdict) for r in urlfilter.judged(urls, none).collect()] == [(None, "allow")]
    assert urlfilter.judged(urls.limit(0), urlfilter.rule_table(spark, URL_RULES)).count() == 0


def test_bloom_has_no_false_negative_and_is_native(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host "), F.col("id").cast("string")).alias("key"))
    blocks = 190
    table = urlfilter.bloom(keys, blocks)
    assert table.count() <= blocks
    hit = None
    for i, b in enumerate(urlfilter._slots(F.col("key"))):
        own = F.col(f"w{i}").bitwiseAND(b) != 0
        hit = own if hit is None else hit & own
    probe = lambda k: k.withColumn("block", urlfilter._block(F.col("key"), blocks)).join(table, "block").filter(hit).count()
    assert probe(keys) == 3000
    others = spark.range(3000).select(F.concat(F.lit("other "), F.col("id").cast("string")).alias("key"))
    assert probe(others) < 150
    plan = urlfilter.judged(spark.createDataFrame([("u",)], "url string"), urlfilter.rule_table(spark, URL_RULES))
    assert "Python" not in plan._jdf.queryExecution().toString().replace("applySchemaToPythonRDD", "")
