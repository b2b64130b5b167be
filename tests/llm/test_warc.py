"""ARC and WARC: exact round trips, both versions, revisits."""

import base64
import hashlib
import random

import pytest

from acctsig.llm import warc
from acctsig.llm.common import scratch

SCHEMA = "page_id long, url string, html string, record_type string"


def pages():
    rng = random.Random(4)
    big = ["".join(rng.choice("aé\r\n <>") for _ in range(rng.randint(1000, 4000))) for _ in range(5)]
    rows = [(i, f"http://h{i}.org/p", b) for i, b in enumerate(big * 3)]
    rows += [(50, None, None), (51, "no scheme", ""), (52, "http://x y/\n?q", "short"), (53, "http://a/", "short"),
             (None, "http://n/", "n" * 1500), (None, "http://n/", "n" * 1500), (60, "http://m/", "n" * 1500),
             (70, "http://r/", "r" * 999), (71, "http://r/", "r" * 999), (80, "http://s/", "s" * 1000),
             (81, "http://s/", "s" * 1000), (81, "http://s/", "s" * 1000),
             (90, "http://t/", "WARC/1.0\r\n\r\n\r\n\r\n" * 100), (91, "http://u/", "z" * 3_000_000)]
    return rows


def expected(rows):
    out = []
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    seen = set()
    for i, _, h in rows:
        b = (h or "").encode()
        last = max((x for x in by[h or ""] if x is not None), default=None)
        again = len(b) >= 1000 and len(by[h or ""]) > 1 and (i != last or (h, i) in seen)
        seen.add((h, i))
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 6])
def test_pages_through_both_archives(spark, parts):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(parts)
    out = warc.archive(df, scratch(spark, "arc"), scratch(spark, "warc"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert sorted(got, key=str) == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.archive(df, scratch(spark, "arc"), scratch(spark, "warc")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_header_lines(version):
    name = "x.arc"
    buf = warc.filedesc(version, name, "19990102030405") + b"\n"
    at = len(buf)
    buf += warc.arc_record(version, 7, "http://a b/é", "<p>\n1 2 3\n</p>", at, name, "20010203040506") + b"\n"
    end = len(buf)
    buf += warc.arc_record(version, None, None, None, end, name) + b"\n"
    got = list(warc.parse_arc(buf))
    assert [o for _, o, *_ in got] == [0, at, end] and not any(t for *_, t in got)
    assert [warc.warc_fields(name, *r)["warc_type"] for r in got] == ["warcinfo", "response", "response"]
    f = warc.warc_fields(name, *got[1])
    assert f["target_uri"] == "http://a%20b/é" and f["warc_date"] == "2001-02-03T04:05:06Z"
    assert f["page_id"] == 7 and f["payload"] == b"<p>\n1 2 3\n</p>"
    assert f["digest32"] == "sha1:" + base64.b32encode(hashlib.sha1(f["payload"]).digest()).decode()
    if version == 2:
        assert got[1][0]["Result-code"] == "200" and got[1][0]["Offset"] == str(at) and got[1][0]["Filename"] == name
    assert warc.warc_fields(name, *got[2])["target_uri"] == "unknown:"


def test_legacy_oddities():
    # a content type with blanks, an old 12-digit date, a record that is no HTTP, and a file cut short
    buf = (b"dns:a.org 1.2.3.4 199901020304 text/dns; charset=us ascii 5\n12345\n"
           b"http://a/ 1.2.3.4 19990102030405 text/html 100\nHTTP/1.0 200 OK\r\n\r\nbody")
    one, two = warc.parse_arc(buf)
    f = warc.warc_fields("f", *one)
    assert (f["warc_type"], f["content_type"], f["payload"]) == ("resource", "text/dns; charset=us ascii", b"12345")
    assert f["warc_date"] == "1999-01-02T03:04:00Z"
    assert two[3] and warc.warc_fields("f", *two)["payload"] == b"body"
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a/ 1.2.3.4 19990102030405 text/html many\n"))


def test_a_reader_checks_digests_and_lengths():
    rec = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: x\r\n%sContent-Length: 3\r\n\r\nabc\r\n\r\n"
    fields, block = next(warc.parse_warc(rec % b""))
    assert block == b"abc" and fields["warc-type"] == "resource"
    wrong = next(warc.parse_warc(rec % b"WARC-Payload-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\r\n"))
    with pytest.raises(ValueError):
        warc._record_row(*wrong)
    with pytest.raises(ValueError):
        list(warc.parse_warc((rec % b"")[:-5]))
