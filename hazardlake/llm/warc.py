"""Legacy archives: write and parse ARC files, convert them to WARC, read those back.

An archive is one row (name, content) of bounded size, so a folder of archives is a table in any
store that Spark writes. Records are found by their headers' declared lengths alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

# Field names of the two header line versions, and the revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE = "name string, content binary"
ARC_RECORD = ("page_id long, url string, ip string, date string, mime string, version int, head binary, "
              "payload binary, payload_bytes long, payload_digest string")
WARC_RECORD = ("page_id long, url string, date string, record_id string, record_type string, "
               "refers_to long, payload_bytes long, payload_digest string, payload binary")


def _safe(url: str | None) -> str:
    """A header line is split at blanks, so blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()),
                  url or "about:blank")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


ARCHIVE_ARROW = pa.schema([("name", pa.string()), ("content", pa.binary())])
ARC_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()),
                       ("mime", pa.string()), ("version", pa.int32()), ("head", pa.binary()),
                       ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
WARC_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()),
                        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _packed(records: Iterator[bytes], kind: str, start, limit: int) -> Iterator[pa.RecordBatch]:
    """Join records to archives of about ``limit`` bytes; a longer record has one of its own."""
    task, n, parts, held = TaskContext.get().partitionId(), 0, [], 0
    for r in records:
        if parts and held + len(r) > limit:
            yield _batch([(f"{task:06d}-{n:06d}.{kind}", b"".join(parts))], ARCHIVE_ARROW)
            n, parts, held = n + 1, [], 0
        if not parts:
            parts = [start(f"{task:06d}-{n:06d}.{kind}", n)]
        parts.append(r if isinstance(r, bytes) else r(n))
        held += len(parts[-1])
    if parts:
        yield _batch([(f"{task:06d}-{n:06d}.{kind}", b"".join(parts))], ARCHIVE_ARROW)


class _ArcRecord:
    """A record whose header line depends on the version of the archive that it falls into."""

    def __init__(self, url, page_id, payload, date, versions):
        ident = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
        self.body = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n"
                     % (ident, len(payload))) + payload
        self.url, self.date, self.versions = url, date, versions

    def __len__(self):
        return len(self.body) + 100

    def __call__(self, n):
        if self.versions[n % len(self.versions)] == 1:
            line = f"{self.url} 0.0.0.0 {self.date} text/html {len(self.body)}\n"
        else:
            line = f"{self.url} 0.0.0.0 {self.date} text/html 200 - - 0 - {len(self.body)}\n"
        return line.encode() + self.body + b"\n"


def write_arc(pages: DataFrame, date: str = "20240101000000", versions=(1, 2), limit: int = 4 << 20) -> DataFrame:
    """ARC archives of pages (page_id, url, html); versions alternate from archive to archive."""

    def start(name, n):
        version = versions[n % len(versions)]
        body = f"{version} 0 none\n{ARC_FIELDS[version]}\n".encode()
        middle = "text/plain" if version == 1 else "text/plain 200 - - 0 -"
        return f"filedesc://{name} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body + b"\n"

    def write(batches):
        rows = (_ArcRecord(_safe(u.as_py()), i.as_py(), (h.as_py() or "").encode(), date, versions)
                for b in batches for i, u, h in zip(*b.columns))
        return _packed(rows, "arc", start, limit)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, ARCHIVE)


def _arc_records(content: bytes) -> Iterator[tuple]:
    at, version, names = 0, 1, ARC_FIELDS[1].split()
    while at < len(content):
        end = content.index(b"\n", at)
        fields = content[at:end].decode().split(" ")
        size = int(fields[-1])
        body = content[end + 1:end + 1 + size]
        at = end + 1 + size
        while content[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if fields[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            names = body.split(b"\n")[1].decode().split(" ")
            continue
        got = dict(zip(names, fields))
        head, _, payload = body.partition(b"\r\n\r\n")
        ident = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
        yield (int(ident[1]) if ident else None, got["URL"], got["IP-address"], got["Archive-date"],
               got["Content-type"], version, head, payload, len(payload), hashlib.sha1(payload).hexdigest())


def read_arc(archives: DataFrame) -> DataFrame:
    """Records of ARC archives: the header line is read by the fields its archive's version names."""

    def read(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for r in _arc_records(content.as_py()):
                    rows.append(r)
                    held += r[8]
                    if held > 4 << 20:
                        yield _batch(rows, ARC_ARROW)
                        rows, held = [], 0
                yield _batch(rows, ARC_ARROW)

    return archives.select("content").mapInArrow(read, ARC_RECORD)


def _record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    last = (record_id or ":none>").rstrip(">").rpartition(":")[2]
    return None if last == "none" else int(last)


def _digest(hexa: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexa)).decode()


def arc_to_warc(records: DataFrame, min_bytes: int = 1000, limit: int = 4 << 20) -> DataFrame:
    """WARC archives of parsed ARC records, with synthesised ids, times, types and digests.

    Of equal payloads of ``min_bytes`` or more the record with the largest page_id is a response
    and the others are revisits of it, without payload. Rows without page_id never are the
    referred one unless all of a payload are; rows that repeat the largest page_id all are
    responses. Only digests are counted; a payload moves once, and rows of a very common payload
    are split by adaptive execution.
    """
    large = records.where(F.col("payload_bytes") >= min_bytes)
    common = (large.groupBy("payload_digest", "payload_bytes")
              .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .where((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n"))
    typed = (records.join(common, ["payload_digest", "payload_bytes"], "left")
             .withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
             .select("page_id", "url", "ip", "date", "head", "payload", "payload_digest", "refers",
                     F.when(F.col("refers").isNotNull(), F.lit(b"")).otherwise(F.col("payload")).alias("block")))
    typed = typed.drop("payload")

    def record(page_id, url, ip, date, head, digest, refers, block):
        d = date
        when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        block = head + b"\r\n\r\n" + block
        lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
                 f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}",
                 f"WARC-Date: {when}", f"WARC-Payload-Digest: {_digest(digest)}",
                 "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        if refers is not None:
            lines += [f"WARC-Refers-To: {_record_id(refers)}", f"WARC-Profile: {REVISIT}"]
        else:
            lines.append(f"WARC-Block-Digest: {_digest(hashlib.sha1(block).hexdigest())}")
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def start(name, n):
        body = b"software: arc to warc\r\nformat: WARC File Format 1.1\r\n"
        return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Filename: {name}\r\n"
                f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    def write(batches):
        rows = (record(*(v.as_py() for v in r)) for b in batches for r in zip(*b.columns))
        return _packed(rows, "warc", start, limit)

    return typed.mapInArrow(write, ARCHIVE)


def _warc_records(content: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        h = dict(x.split(": ", 1) for x in lines)
        size = int(h["Content-Length"])
        block = content[end + 4:end + 4 + size]
        at = end + 4 + size + 4
        if h["WARC-Type"] == "warcinfo":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
        if h["WARC-Type"] == "response":
            n = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{h['WARC-Record-ID']}: the payload has another digest")
        else:
            n, payload = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]), None
        yield (_page_of(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Record-ID"],
               h["WARC-Type"], _page_of(h.get("WARC-Refers-To")), n, digest, payload)


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Response and revisit records of WARC archives; responses' digests are checked."""

    def read(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for r in _warc_records(content.as_py()):
                    rows.append(r if payloads else (*r[:8], None))
                    held += r[6] * payloads
                    if held > 4 << 20:
                        yield _batch(rows, WARC_ARROW)
                        rows, held = [], 0
                yield _batch(rows, WARC_ARROW)

    return archives.select("content").mapInArrow(read, WARC_RECORD)


def convert_pages(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Pages as legacy archives, converted, written as WARC to the shared folder; the archives."""
    return stored(arc_to_warc(read_arc(write_arc(pages)), min_bytes))


def op9_warc(spark, sf_dir) -> DataFrame:
    archives = convert_pages(table(spark, sf_dir, "pages"))
    return read_warc(archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS keep FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keep <> page_id THEN keep END AS refers_to FROM r"""
