"""Legacy archive converter: ARC files of version 1 and 2 to WARC/1.1, and a WARC reader.

An ARC file opens with a version block that names its version and header fields; each record has a header
line of that version (five fields, or ten with result code, checksum, location, offset and file name), the
declared number of bytes and a newline. Header lines are split from the right, except that of a version-1 line the
content type is all that follows the date (it may hold spaces), and are bytes: what is no UTF-8 is
percent-encoded. The converter follows the declared lengths, never the content. A record whose header cannot
be read, or that declares more bytes than are left, is set aside with the rest of its file, and counted
(``set_aside``). For each record it synthesises a record id (a UUID from its archive, place, URL, date and
digest), a WARC-Date, the type and SHA-256 block and payload digests. Of records with equal payloads of at
least ``revisit_bytes`` bytes one becomes the response, the others revisit records without a payload that
refer to it by its id, URL and date: the one with the smallest page id, else (no record has one) with the
smallest record id.

Archives are written by Spark's text writer with the record's closing blank lines as line separator, so
they can stand in any store that Spark reads; a file is one gzip stream. They are read back by declared
lengths, a file of some megabytes as one row. Null payloads are empty; null or unprintable URLs are
percent-encoded or replaced by ``urn:x-page:<id>``. Payloads hold any bytes, record marks included; bytes
that are no UTF-8 are written by a lossless stand-in and marked. Rows with equal ids are records of their own,
equal rows too. Empty tables give no archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, broadcast_if_small
from .text import slices

REVISIT_BYTES = 100
SEGMENT_BYTES = 4 << 20
OWNER_ROWS = 100_000
DATE = "20240101000000"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the UUID namespace of URLs
_FIELDS = {  # fixed values: the header fields that the version block of each ARC version names
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# ARC


def arc_url(url: str | None, page_id: object) -> str:
    clean = quote(url.strip(), safe="%/:=&?~#+!$,;'@()*[]") if url else ""
    return clean or f"urn:x-page:{page_id}"


def arc_segment(rows: list[tuple[object, str | None, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of HTTP responses, for (page id, url, payload) rows."""
    out = io.BytesIO()
    block = b"%d 0 loomline\n%s\n" % (version, _FIELDS[version])
    tail = f"200 - - 0 {name} " if version == 2 else ""
    out.write(f"filedesc://{name} 0.0.0.0 {DATE} text/plain {tail}{len(block)}\n".encode() + block + b"\n")
    for page_id, url, payload in rows:
        told = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{told}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        tail = f"200 - - {out.tell()} {name} " if version == 2 else ""
        out.write(f"{arc_url(url, page_id)} 0.0.0.0 {DATE} text/html {tail}{len(body)}\n".encode() + body + b"\n")
    return out.getvalue()


class BadRecord(ValueError):
    """An ARC record that cannot be read, and what follows it in its file."""


def _header(line: bytes, version: int) -> dict[str, str]:
    """Fields of a header line, by the names of its version."""
    names = [x.decode() for x in _FIELDS[version].split(b" ")]
    if version == 1:  # the URL, the address and the date have no spaces; a content type may
        front, _, length = line.rstrip().rpartition(b" ")
        found = re.match(rb"(\S.*?) +(\S+) +(\d{4,14}) *(.*)\Z", front, re.S)
        values = [*found.groups(), length] if found else []
    else:  # the nine fields after a content type and before a URL
        found = re.match(rb"(\S.*?) +(\S+) +(\d{4,14}) +(.*?) +(\S+) +(\S+) +(\S+) +(\S+) +(\S+) +(\d+)\Z", line.rstrip(), re.S)
        values = [*found.groups()] if found else []
    if len(values) != len(names) or not values[-1].isdigit():
        raise BadRecord(f"not a header line of version {version}: {line[:80]!r}")
    return {k: _told(v) for k, v in zip(names, values, strict=True)}


def _told(value: bytes) -> str:
    try:
        return value.decode()
    except UnicodeDecodeError:
        return quote(value, safe="%/:=&?~#+!$,;'@()*[] -.")


def read_arc(content: bytes, bad: list[str] | None = None) -> Iterator[dict]:
    """The records of an ARC file after its version block: header fields by name, ``body`` and the place ``at``.

    What cannot be read is raised as BadRecord, or with ``bad`` noted there.
    """
    version, at = None, 0
    try:
        while at < len(content):
            end = content.find(b"\n", at)
            line = content[at : end if end >= 0 else len(content)]
            if not line.strip():
                at += len(line) + 1
                continue
            if version is None:
                if not line.startswith(b"filedesc://") or not line.rsplit(b" ", 1)[-1].strip().isdigit():
                    raise BadRecord("an ARC file must open with its version block")
                fields, length = {}, int(line.rsplit(b" ", 1)[-1])
            else:
                fields = _header(line, version)
                length = int(fields["Archive-length"])
            start = at + len(line) + 1
            body = content[start : start + length]
            if len(body) < length:
                raise BadRecord(f"an ARC record at byte {at} declares {length} bytes; {len(body)} are left")
            if version is None:
                first = body.split(b" ", 1)[0].strip()
                if first not in (b"1", b"2"):
                    raise BadRecord(f"no ARC version {first[:20]!r}")
                version = int(first)
            else:
                yield fields | {"body": body, "at": at}
            at = start + length
    except BadRecord as e:
        if bad is None:
            raise
        bad.append(str(e))


def http_parts(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes and payload of an HTTP response; a body without a header is all payload."""
    cut = body.find(b"\r\n\r\n")
    if not body.startswith(b"HTTP/") or cut < 0:
        return {}, b"", body
    head = body[: cut + 4]
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return fields, head, body[cut + 4 :]


# WARC


def record_id(arc: dict, digest: str, archive: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive} {arc["at"]} {arc["URL"]} {arc["Archive-date"]} {digest}')}>"


def page_id_of(fields: dict[str, str]) -> int | None:
    told = fields.get("X-Page-Id", "").strip()
    return int(told) if re.fullmatch(r"-?\d{1,18}", told) else None


def warc_date(arc_date: str) -> str:
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(arc: dict, own_id: str, owner: dict | None = None) -> bytes:
    """The WARC record of an ARC record, without its closing blank lines; ``owner`` is what it revisits."""
    fields, head, payload = http_parts(arc["body"])
    digest, page_id = hashlib.sha256(payload).hexdigest(), page_id_of(fields)
    block, is_http = arc["body"] if owner is None else head, bool(head)
    try:
        block.decode()
        coded = False
    except UnicodeDecodeError:
        coded, plain = True, block
        block = block.decode("latin-1").encode()
    kind = "application/http; msgtype=response" if is_http else arc.get("Content-type") or "application/octet-stream"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if owner else 'response' if is_http else 'resource'}",
        f"WARC-Record-ID: {own_id}",
        f"WARC-Date: {warc_date(arc['Archive-date'])}",
        f"WARC-Target-URI: {arc['URL']}",
        f"WARC-IP-Address: {arc['IP-address']}",
        f"Content-Type: {kind}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if coded:
        lines.append(f"X-Stored-As: latin-1 in UTF-8; {len(plain)} bytes")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if owner:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {owner['id']}",
            f"WARC-Refers-To-Target-URI: {owner['url']}",
            f"WARC-Refers-To-Date: {warc_date(owner['date'])}",
        ]
        if owner["page_id"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {owner['page_id']}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            fields[k] = v
        block = stream.read(int(fields["Content-Length"]))
        if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise ValueError(f"{fields['WARC-Record-ID']} differs from its block digest")
        if "X-Stored-As" in fields:
            block = block.decode().encode("latin-1")
        yield fields, block


# Spark


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, b in enumerate(slices(batches, "html", SEGMENT_BYTES)):
        html = b.column("html").cast(pa.binary())
        rows = [(p, u, h.as_py() or b"") for p, u, h in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), html, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([arc_segment(rows, 1 + i % 2)], pa.binary())], ["content"])


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """Rows (content) of ARC files of both versions, each of some megabytes."""
    return pages.select("page_id", "url", "html").mapInArrow(_segments, "content binary")


_KEPT = {"digest": "binary", "id": "string", "page_id": "long", "url": "string", "date": "string"}


def _each(content: bytes, bad: list[str] | None = None) -> Iterator[tuple[dict, bytes, str, int | None, int]]:
    """Each record with its payload digest, record id, page id and payload length."""
    archive = xxhash.xxh3_128_hexdigest(content)
    for arc in read_arc(content, [] if bad is None else bad):
        fields, _, payload = http_parts(arc["body"])
        digest = hashlib.sha256(payload)
        yield arc, digest.digest(), record_id(arc, digest.hexdigest(), archive), page_id_of(fields), len(payload)


def _payloads(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(digest, i, page_id, arc["URL"], arc["Archive-date"]) for content in b.column("content") for arc, digest, i, page_id, size in _each(content.as_py()) if size >= least]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], list(_KEPT))

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "id", "page_id", "url", "ip", "kind", "date", "body"]
    types = [pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    for b in batches:
        for content in b.column("content"):
            rows = [(digest, i, page_id, arc["URL"], arc["IP-address"], arc["Content-type"], arc["Archive-date"], arc["body"]) for arc, digest, i, page_id, _ in _each(content.as_py())]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for own, url, ip, kind, date, body, owner in zip(*(b.column(c).to_pylist() for c in ("id", "url", "ip", "kind", "date", "body", "owner")), strict=True):
            arc = {"URL": url, "IP-address": ip, "Content-type": kind, "Archive-date": date, "body": body}
            out.append(warc_record(arc, own, owner if owner is not None and owner["id"] != own else None))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def set_aside(arcs: DataFrame) -> DataFrame:
    """Rows (reason) of the files of which a part cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad: list[str] = []
            for content in b.column("content"):
                for _ in read_arc(content.as_py(), bad):
                    pass
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["reason"])

    return arcs.select("content").mapInArrow(run, "reason string")


def convert(arcs: DataFrame, to: str, revisit_bytes: int = REVISIT_BYTES, ws: Workspace | None = None) -> None:
    """Convert ARC files (rows with their content) to gzipped WARC files in the folder ``to``."""
    ws = ws or Workspace(arcs.sparkSession)
    seen = arcs.select("content").mapInArrow(_payloads(revisit_bytes), ", ".join(f"{c} {t}" for c, t in _KEPT.items()))
    owner = F.struct("id", "page_id", "url", "date")
    owners = seen.groupBy("digest").agg(F.min_by(owner, F.struct(F.col("page_id").isNull(), "page_id", "id")).alias("owner"), F.count("*").alias("c"))
    owners = ws.save(owners.where("c > 1").select("digest", "owner"), "owners")
    records = arcs.select("content").mapInArrow(_records, "digest binary, id string, page_id long, url string, ip string, kind string, date string, body binary")
    joined = records.join(broadcast_if_small(owners, OWNER_ROWS), "digest", "left")
    text = joined.select("id", "url", "ip", "kind", "date", "body", "owner").mapInArrow(_to_warc, "value binary")
    # WARC text is UTF-8 by construction: headers are text, blocks that are not are stored by a stand-in
    text.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(to)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date", "refers_to_id"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for content in b.column("content"):
            rows = []
            for fields, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                if fields["WARC-Type"] in ("response", "resource"):
                    payload = http_parts(block)[2]
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"{fields['WARC-Record-ID']} differs from its payload digest")
                page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                rows.append((None if page is None else int(page), size, digest, fields["WARC-Type"], None if to is None else int(to), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], fields.get("WARC-Refers-To")))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each WARC record, its digests verified against its content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string, refers_to_id string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ws = Workspace(spark)
    to = ws.path("warc")
    convert(pages_to_arc(pages), to, ws=ws)
    return read_archives(spark, to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN owner < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner < page_id THEN owner END AS refers_to
FROM p LEFT JOIN o ON o.payload_digest = p.payload_digest
"""
