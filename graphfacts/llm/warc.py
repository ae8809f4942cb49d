"""Legacy ARC archives converted to WARC.

An archive is what lies between its first byte and its last: a version record, then records of a header line and as
many bytes as that line declares. Version 1 lines have five fields, version 2 lines ten. The converter reads lines by
the archive's own version, takes bodies by declared length only, and synthesises what WARC asks for and ARC lacks:
record identifiers, W3C timestamps, record types and block and payload digests.

Archives are written by Spark's text writer, one per partition: every row is a record and the line feed between rows
is the one that both formats put after a record. They are read by Spark's binary reader, so any store will do.
"""

from __future__ import annotations

import gzip
import re
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterator
from datetime import datetime, timezone
from hashlib import sha1
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfacts.plans import tables

#: Payloads below this many bytes are stored again rather than referred to.
LEAST = 1000
#: Bytes of payload aimed at in one archive file.
ARCHIVE = 16 << 20

# The fields of a record's header line in either version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:archive-record")
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc).timestamp()
HEAD_END = b"\r\n\r\n"


class ArcRecord(NamedTuple):
    url: str
    date: str
    kind: str
    body: bytes


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, archive: str) -> bytes:
    """One ARC record without the line feed that follows it."""
    # a header line is split at spaces, so none may stand in a field
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "-"
    fields = {"url": url, "ip": "0.0.0.0", "date": date, "type": kind.split(";")[0].strip().replace(" ", "") or "-", "result": "200",
              "checksum": "-", "location": "-", "offset": "0", "filename": archive, "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_version(version: int, archive: str) -> bytes:
    """The record that opens an archive."""
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{archive}", "20000101000000", "text/plain", body, archive)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive. The version record says how the other header lines read; a length that leaves the
    archive, or a line of another shape, is an error, not a shorter result."""
    at, version, end = 0, 0, len(data)
    while at < end:
        if data[at] == 10:  # line feeds stand between records
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"no header line at byte {at}")
        fields = data[at:stop].rstrip(b"\r").decode("latin-1").split(" ")
        if not version:
            if not fields[0].startswith("filedesc:"):
                raise ValueError("the archive does not begin with a version record")
            length = int(fields[-1])
            version = int(data[stop + 1:stop + 3].split()[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"archive version {version} is not known")
        else:
            names = ARC_FIELDS[version]
            if len(fields) != len(names):
                raise ValueError(f"header line at byte {at} has {len(fields)} fields; version {version} has {len(names)}")
            named = dict(zip(names, fields))
            length = int(named["length"])
        if length < 0 or stop + 1 + length > end:
            raise ValueError(f"record at byte {at} declares {length} bytes, more than there are")
        if fields[0][:9] != "filedesc:":
            yield ArcRecord(named["url"], named["date"], named["type"], data[stop + 1:stop + 1 + length])
        at = stop + 1 + length


def payload_of(body: bytes) -> tuple[bytes, bytes]:
    """The protocol header, with the empty line that ends it, and the payload behind it."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    stop = body.find(HEAD_END)
    return (body, b"") if stop < 0 else (body[:stop + 4], body[stop + 4:])


def labelled(digest: bytes) -> str:
    return "sha1:" + b32encode(digest).decode()


def warc_record(kind: str, url: str, date: str, identifier: str, block: bytes, payload_digest: bytes, refers_to: str | None) -> bytes:
    """One WARC record, less its last line feed."""
    when = datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Target-URI: {url}", f"WARC-Date: {when}",
            f"WARC-Payload-Digest: {labelled(payload_digest)}", f"WARC-Block-Digest: {labelled(sha1(block).digest())}",
            "Content-Type: application/http; msgtype=response"]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + HEAD_END + block + b"\r\n\r"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(HEAD_END, at)
        if data[at:at + 5] != b"WARC/" or stop < 0:
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:stop].decode().split("\r\n")[1:])}
        length = int(head["content-length"])
        block = data[stop + 4:stop + 4 + length]
        if len(block) != length or data[stop + 4 + length:stop + 8 + length] != HEAD_END:
            raise ValueError(f"record at byte {at} does not end where it declares")
        yield head, block
        at = stop + 8 + length


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(key))}>"


def _each(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows one at a time, so that only one large value is a Python object at once."""
    for batch in batches:
        held = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in held)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, (bytes, str)) else 8 for v in row)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _written(records: DataFrame, name: str) -> str:
    """Write the column ``record`` as archives into a new shared folder; its path. The archives are read soon and once or
    twice: gzip's fastest level costs a fraction of the time of its usual one."""
    path = f"{tables.work_dir(records.sparkSession)}/{name}/{uuid.uuid4().hex}"
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").text(path)
    return path


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")


def write_arc(pages: DataFrame) -> str:
    """``pages(page_id, url, html)`` as ARC archives, versions 1 and 2 in turn by partition; the folder's path.

    The page's identifier travels in a protocol header. Null html is an empty payload, null url the field ``-``.
    """
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, archive = part % 2 + 1, f"part-{part:06d}.arc"

        def rows() -> Iterator[tuple]:
            yield (arc_version(version, archive),)
            for page, url, html in _each(batches, "page_id", "url", "html"):
                date = datetime.fromtimestamp(EPOCH + (page or 0) % 800_000_000, timezone.utc).strftime("%Y%m%d%H%M%S")
                name = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{name}Content-Length: {len(html)}\r\n\r\n".encode()
                yield (arc_record(version, url, date, "text/html", head + html, archive),)

        return _batches(rows(), pa.schema([("record", pa.binary())]))

    return _written(kept.mapInArrow(run, "record binary"), "arc")


ROW = pa.schema([("key", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("head", pa.binary()), ("payload", pa.binary()),
                 ("bytes", pa.int64()), ("digest", pa.binary())])
PAGE_ID = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n")


def arc_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(key, url, date, head, payload, bytes, digest)`` of every record of the archives under ``path``; ``key`` is
    null where no page is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (content,) in _each(batches, "content"):
                for r in read_arc(gzip.decompress(content)):
                    head, payload = payload_of(r.body)
                    named = PAGE_ID.search(head)
                    yield int(named[1]) if named else None, r.url, r.date, head, payload, len(payload), sha1(payload).digest()

        return _batches(rows(), ROW)

    return _archives(spark, path).mapInArrow(run, "key long, url string, date string, head binary, payload binary, bytes long, digest binary")


def convert(spark: SparkSession, path: str, least: int = LEAST) -> str:
    """The ARC archives under ``path`` as WARC archives; their folder.

    Of records with equal payloads of at least ``least`` bytes, that with the largest key is the response; the others
    become revisits that refer to it and keep the protocol header alone. The choice is one aggregation over digests
    whose partial maxima leave at most a row for each digest and task; only digests that occur twice are joined back.
    """
    index = tables.materialize(arc_rows(spark, path).filter(f"bytes >= {least}").select("digest", "bytes", "key"))
    kept = (index.groupBy("digest", "bytes").agg(F.max("key").alias("kept"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1 AND kept IS NOT NULL").select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "kept"))
    refers = (index.join(kept, (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")))
              .filter("key IS NULL OR key <> kept").select(F.col("key").alias("_key"), "_digest", "kept").distinct())
    rows = arc_rows(spark, path)
    rows = rows.join(tables.materialize(refers), F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for key, url, date, head, payload, digest, kept in _each(batches, "key", "url", "date", "head", "payload", "digest", "kept"):
                revisit = kept is not None
                yield (warc_record("revisit" if revisit else "response", url, date, record_id(key), head if revisit else head + payload,
                                   digest, record_id(kept) if revisit else None),)

        return _batches(out(), pa.schema([("record", pa.binary())]))

    return _written(rows.select("key", "url", "date", "head", "payload", "digest", "kept").mapInArrow(run, "record binary"), "warc")


def warc_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_id, payload_bytes, payload_digest, record_type, refers_to_id)`` of the archives under ``path``.
    A response's digest is computed from its payload and must agree with its header; a revisit's digest and length are
    those its headers give for the full payload."""
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (content,) in _each(batches, "content"):
                for head, block in read_warc(gzip.decompress(content)):
                    protocol, payload = payload_of(block)
                    declared = b32decode(head["warc-payload-digest"].partition(":")[2])
                    if head["warc-type"] == "response":
                        size, digest = len(payload), sha1(payload).digest()
                        if digest != declared:
                            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                    else:
                        size, digest = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", protocol)[1]), declared
                    named = PAGE_ID.search(protocol)
                    yield (int(named[1]) if named else None, head["warc-record-id"], size, digest.hex(), head["warc-type"],
                           head.get("warc-refers-to"))

        return _batches(rows(), schema)

    return _archives(spark, path).mapInArrow(
        run, "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to_id string")


def round_trip(pages: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row per input row: pages written as ARC,
    converted to WARC and read back.

    Null html is an empty payload; payloads below the least size are always responses. A null ``page_id`` never wins a
    group and is a response where its group has no other; rows that repeat an identifier and its payload have one
    verdict. ``refers_to`` is the page of the record that a revisit's WARC-Refers-To names. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = pages.sparkSession
    size = pages.select(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    files = max(1, -(-size // ARCHIVE))
    pages = pages.select("page_id", "url", "html").repartition(files)
    rows = tables.materialize(warc_rows(spark, convert(spark, write_arc(pages))))
    told = rows.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to")).distinct()
    named = rows.filter("refers_to_id IS NOT NULL").select("refers_to_id").distinct()
    told = told.join(named, F.col("_id") == F.col("refers_to_id"), "left_semi")
    return rows.join(told, F.col("refers_to_id") == F.col("_id"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND kept <> page_id THEN kept END AS refers_to
FROM k
"""
