"""Legacy ARC archives to WARC.

ARC files hold, per document, one header line whose fields depend on the
file's version (declared in its ``filedesc`` record), then as many bytes as
the line's last field declares. ``convert`` parses them and makes the
equivalent WARC fields: a record id (a name-based UUID of file and offset),
an ISO timestamp, a record type, and block and payload digests. Records
whose payload was met before become ``revisit`` records, the rest is written
whole. Archives are written and read through Spark's own readers and
writers, so that any store that Spark knows will do:

- an ARC record ends with a newline and a WARC record with CR LF CR LF, which
  are the text writer's line separators, so each row is one record;
- a file is read as a whole (``binaryFile``), gzip or not. Each partition of
  the pages becomes one ARC file, and that one WARC file, without a shuffle:
  the size of scan partitions (``spark.sql.files.maxPartitionBytes``) bounds
  the files. Repartition pages that come in larger partitions.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm.common import prepare, saved, slices

# Fixed values of the two format versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}
GZIP = b"\x1f\x8b"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
DEFAULT_DATE = "20240101000000"
# Repeated payloads (a digest and an original of each) up to this number are broadcast.
BROADCAST_ROWS = 200_000
_OUT_BYTES = 4_000_000

CONVERTED = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()),
    T.StructField("warc_date", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("ip", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("truncated", T.BooleanType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("digest32", T.StringType()), T.StructField("block_digest", T.StringType()),
    T.StructField("http_header", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])
READ = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("warc_date", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to_id", T.StringType()),
])


# ---- ARC ------------------------------------------------------------------

def _line(version: int, url: str, ip: str, date: str, mime: str, length: int, offset: int, name: str) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{more} {length}\n".encode()


def filedesc(version: int, name: str, date: str) -> bytes:
    """The record that opens an ARC file and declares its version."""
    block = f"{version} 0 acctsig\n{ARC_FIELDS[version]}\n".encode()
    return _line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(block), 0, name) + block


def _clean_url(url: str | None) -> str:
    """A header line's field has no white space or controls: they are percent-encoded."""
    if not url:
        return "unknown:"
    return re.sub("[\\x00-\\x20\\x7f-\\xa0\\u2028\\u2029]",
                  lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None,
               offset: int, name: str, date: str = DEFAULT_DATE) -> bytes:
    """One legacy record: a header line and an HTTP response with the page as its body."""
    body = (html or "").encode("utf-8", "surrogatepass")
    tag = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(body)}\r\n{tag}\r\n").encode() + body
    return _line(version, _clean_url(url), "0.0.0.0", date, "text/html", len(block), offset, name) + block


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """Write ``pages(page_id, url, html)`` as ARC files of the versions in turn."""
    prepare(pages)

    def run(batches):
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], f"pages-{part:06d}.arc"
        head = filedesc(version, name, DEFAULT_DATE)
        offset, rows = len(head) + 1, [head]
        for batch in batches:
            for a, b in slices(batch, "html", _OUT_BYTES):
                cut = batch.slice(a, b - a).to_pydict()
                for page_id, url, html in zip(cut["page_id"], cut["url"], cut["html"]):
                    rows.append(arc_record(version, page_id, url, html, offset, name))
                    offset += len(rows[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    (pages.select(F.col("page_id").cast("long"), "url", "html")
     .mapInArrow(run, "value binary")
     .select(F.col("value").cast("string"))
     .write.option("lineSep", "\n").option("compression", "gzip").text(path))


def parse_arc(buf: bytes) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """``(header fields, offset, content, truncated)`` of each record of one ARC file.

    The field names are those that the file's version block declares. A
    content type with spaces (seen in version 1 files) is put together again.
    A declared length beyond the end of the file gives what is there and
    ``truncated``.
    """
    names, pos = ARC_FIELDS[1].split(" "), 0
    while pos < len(buf):
        if buf[pos] in b"\r\n":
            pos += 1
            continue
        end = buf.find(b"\n", pos)
        if end < 0:
            raise ValueError(f"no header line at offset {pos}")
        parts = buf[pos:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no declared length at offset {pos}")
        content = buf[end + 1:end + 1 + int(parts[-1])]
        if parts[0].startswith("filedesc://"):
            declared = content.split(b"\n")
            version = int(declared[0].split(b" ")[0])
            names = (declared[1].decode().strip().split(" ") if len(declared) > 1 and declared[1].strip()
                     else ARC_FIELDS[version].split(" "))
        extra = len(parts) - len(names)
        if extra > 0:
            parts[3:4 + extra] = [" ".join(parts[3:4 + extra])]
        yield dict(zip(names, parts)), pos, content, len(content) < int(parts[-1])
        pos = end + 1 + int(parts[-1])


def _iso(date: str) -> str:
    """A 14-digit (or older 12-digit) ARC date as a WARC date."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_fields(file: str, fields: dict[str, str], offset: int, content: bytes, truncated: bool) -> dict:
    """The equivalent WARC record of a parsed ARC record."""
    url = fields["URL"]
    head, payload, page_id = b"", content, None
    if url.startswith("filedesc://"):
        kind = "warcinfo"
    elif content.startswith(b"HTTP/"):
        kind, cut = "response", content.find(b"\r\n\r\n")
        if cut >= 0:
            head, payload = content[:cut + 4], content[cut + 4:]
        m = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
        page_id = int(m[1]) if m else None
    else:
        kind = "resource"
    sha = hashlib.sha1(payload)
    return {
        "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{offset}")), "warc_type": kind,
        "warc_date": _iso(fields["Archive-date"]), "target_uri": url, "ip": fields["IP-address"],
        "content_type": "application/http; msgtype=response" if head else fields["Content-type"],
        "page_id": page_id, "truncated": truncated, "payload_bytes": len(payload),
        "payload_digest": sha.hexdigest(), "digest32": _base32(sha.digest()),
        "block_digest": _base32(hashlib.sha1(content).digest()), "http_header": head, "payload": payload,
    }


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(files: DataFrame, rows_of, schema: T.StructType) -> DataFrame:
    arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(),
                                 "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, held = batch.column(0)[i].as_py(), [], 0
                buf = batch.column(1)[i].as_py()
                if buf.startswith(GZIP):
                    buf = gzip.decompress(buf)
                for row in rows_of(path, buf):
                    rows.append(row)
                    held += len(row.get("payload", b"")) + 500
                    if held > _OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


def convert(spark: SparkSession, path: str) -> DataFrame:
    """The WARC fields and contents of all records of the ARC files below ``path``."""
    prepare(spark.range(0))

    def rows_of(file, buf):
        name = file.rsplit("/", 1)[-1]
        return (warc_fields(name, *record) for record in parse_arc(buf))

    return _parsed(_whole_files(spark, path), rows_of, CONVERTED)


# ---- WARC -----------------------------------------------------------------

def marked_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``records`` with ``of``: the record that a response only repeats, else null.

    Of responses with equal payloads of at least ``min_bytes`` that with the
    largest page id (nulls lowest, then the largest record id) is the
    original. Only (digest, record id) rows are aggregated, with map-side
    partials, and only payloads that occur twice are joined back: by a
    broadcast if their number is within ``BROADCAST_ROWS``, so that no
    payload is shuffled, else by a join on the digest that AQE splits.
    """
    own = F.struct("page_id", "record_id", "target_uri", "warc_date")
    first = (records.filter((F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes))
             .groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max(own).alias("of"))
             .filter("n > 1").drop("n"))
    first = saved(first)
    if first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    again = F.col("of.record_id").isNotNull() & (F.col("of.record_id") != F.col("record_id")) \
        & (F.col("warc_type") == "response")
    return (records.join(first, ["payload_digest", "payload_bytes"], "left")
            .withColumn("of", F.when(again, F.col("of"))))


def _header(name: str, value: Column) -> Column:
    """One header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(records: DataFrame, path: str) -> None:
    """Write converted records with their ``of`` marks as WARC/1.0 files."""
    again = F.col("of").isNotNull()
    body = F.concat(F.col("http_header").cast("string"),
                    F.when(again, F.lit("")).otherwise(F.col("payload").cast("string")))
    uid = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.col("warc_type"))
    http = F.length("http_header") > 0
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", uid(F.col("record_id"))),
        _header("WARC-Date", F.col("warc_date")),
        _header("WARC-Target-URI", F.when(F.col("warc_type") != "warcinfo", F.col("target_uri"))),
        _header("WARC-Filename", F.when(F.col("warc_type") == "warcinfo", F.col("target_uri"))),
        _header("WARC-IP-Address", F.when(F.col("warc_type") != "warcinfo", F.col("ip"))),
        _header("WARC-Payload-Digest", F.when(http, F.col("digest32"))),
        _header("WARC-Block-Digest", F.when(~again, F.col("block_digest"))),
        _header("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
        _header("WARC-Refers-To", F.when(again, uid(F.col("of.record_id")))),
        _header("WARC-Refers-To-Target-URI", F.when(again, F.col("of.target_uri"))),
        _header("WARC-Refers-To-Date", F.when(again, F.col("of.warc_date"))),
        _header("WARC-Truncated", F.when(F.col("truncated"), F.lit("length"))),
        _header("Content-Type", F.col("content_type")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    (records.select(F.concat(head, body).alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path))


def parse_warc(buf: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields in lower case, block)`` of each record of one WARC file."""
    pos = 0
    while pos < len(buf):
        if not buf.startswith(b"WARC/", pos):
            raise ValueError(f"no WARC record at offset {pos}")
        end = buf.index(b"\r\n\r\n", pos)
        lines = buf[pos:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(fields["content-length"])
        if buf[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the declared length does not end the record at offset {pos}")
        yield fields, buf[start:start + size]
        pos = start + size + 4


def _bare(uid: str | None) -> str | None:
    return uid.removeprefix("<urn:uuid:").removesuffix(">") if uid else None


def _record_row(fields: dict[str, str], block: bytes) -> dict:
    cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    head = block[:cut]
    tag = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    given = fields.get("warc-payload-digest")
    digest = base64.b32decode(given.removeprefix("sha1:")).hex() if given else None
    if fields["warc-type"] == "revisit":
        declared = re.search(rb"(?i)\r\nContent-Length: *(\d+)\r\n", head)
        size = int(declared[1]) if declared else None
    else:
        own = hashlib.sha1(block[cut:]).hexdigest()
        if digest not in (None, own):
            raise ValueError(f"payload digest of {fields['warc-record-id']} does not fit")
        size, digest = len(block) - cut, own
    return {"record_id": _bare(fields["warc-record-id"]), "record_type": fields["warc-type"],
            "warc_date": fields["warc-date"], "target_uri": fields.get("warc-target-uri"),
            "page_id": int(tag[1]) if tag else None, "payload_bytes": size, "payload_digest": digest,
            "refers_to_id": _bare(fields.get("warc-refers-to"))}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``; whole payloads are checked against their digests."""
    prepare(spark.range(0))
    return _parsed(_whole_files(spark, path),
                   lambda _, buf: (_record_row(*r) for r in parse_warc(buf)), READ)


def archive(pages: DataFrame, arc_path: str, warc_path: str,
            min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages to ARC files, those to WARC files, and what a reader finds there, per page.

    Null html is an empty payload, a null url the target ``unknown:``; a null
    page id is carried as no id. Of repeated rows with equal payloads of
    ``min_bytes`` or more one is the response and the others revisit it, even
    where their page ids are equal. An empty table gives no page. Columns
    beside the three are not read.
    """
    spark = pages.sparkSession
    write_arc(pages, arc_path)
    write_warc(marked_revisits(convert(spark, arc_path), min_bytes), warc_path)
    found = read_warc(spark, warc_path).filter("record_type <> 'warcinfo'")
    whole = (found.filter("record_type = 'response'")
             .select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")))
    return found.join(whole, "refers_to_id", "left")
