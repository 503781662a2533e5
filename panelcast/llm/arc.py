"""Legacy archives: ARC files are parsed and written anew as WARC files.

An ARC file starts with a version block whose second line names the version; a record's header
line has five fields in version 1 (URL, IP, date, type, length) and ten in version 2 (with result
code, checksum, location, offset and file name before the length). The declared length says where
the record ends, so payloads may hold anything. URLs may hold blanks: fields are taken from the right.

``to_warc`` parses each ARC, then synthesises per record: a record id (UUID of archive and
record number, the same on every run), the ISO date of the 14-digit one, the record type, SHA-1
digests of payload and block. Of equal payloads the record with the largest key stays a response, the
others become revisits that refer to its id and keep their HTTP header only.

Archives are files of bounded size written by Spark's text sink into the shared folder, one row
per archive, gzip-compressed, and read by the binaryFile source, so driver and
executors exchange nothing but paths and small rows. Which records are equal is found on
(digest, key) rows by one aggregate with map-side combine and a join back; the archives themselves are
shuffled once, compressed, to meet the decisions on their own records. One archive is
decompressed at a time.

Defined results: null payloads are empty, and equal to each other; a null or repeated key is
allowed (null counts as smallest; of equal keys the record in the later archive is the
response); a header line that can't be parsed is skipped up to the next line that can; a declared
length beyond the end of the file gives a record marked truncated; records that aren't
HTTP become resources, with their whole block as payload; an empty table gives no
archive rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, partitions_for, saved

ARCHIVE_BYTES = 8_000_000
PARTITION_BYTES = 64_000_000
KEY_HEADER = "X-Record-Key"
#: The field lines of the two versions of the format.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_EPOCH = datetime(2001, 1, 1, tzinfo=timezone.utc)


@dataclass
class ArcRecord:
    uri: str
    ip: str
    date: str
    mime: str
    length: int
    block: bytes
    truncated: bool = False

    @property
    def is_http(self) -> bool:
        return self.block[:5] == b"HTTP/"

    def parts(self) -> tuple[bytes, bytes]:
        """The HTTP header with its blank line, and the payload."""
        if not self.is_http:
            return b"", self.block
        for blank in (b"\r\n\r\n", b"\n\n"):
            at = self.block.find(blank)
            if at >= 0:
                return self.block[:at + len(blank)], self.block[at + len(blank):]
        return self.block, b""


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_field(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", header)
    return found[1].decode("utf-8", "replace") if found else None


# ---- ARC -------------------------------------------------------------------------------------

def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 Archive\n{FIELDS[version]}\n\n".encode()
    head = f"filedesc://{name} 0.0.0.0 20010101000000 text/plain "
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"{head}{more}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, uri: str, key: object, date: str, payload: bytes, offset: int) -> bytes:
    header = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{KEY_HEADER}: {'' if key is None else key}\r\n"
              f"Content-Length: {len(payload)}\r\n\r\n").encode()
    more = "" if version == 1 else f"200 {sha1(payload)} - {offset} {name} "
    line = f"{uri} 0.0.0.0 {date} text/html {more}{len(header) + len(payload)}\n"
    return line.encode() + header + payload


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block left out."""
    at, version, begun = 0, 1, False
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        at = end + 1
        fields = line.split(b" ")
        if len(fields) < 5 or not fields[-1].isdigit():
            continue  # the blank line between records, or one that can't be parsed
        is_start = line.startswith(b"filedesc://") and not begun   # only the first block is a version block
        if is_start:
            first = data[at:at + 2]
            version = 2 if first[:1] == b"2" else 1
        after = 4 if version == 1 else 9  # fields right of the URL
        if len(fields) <= after:
            continue
        right = [x.decode("utf-8", "replace") for x in fields[-after:]]
        ip, date, mime = right[:3]
        if not re.fullmatch(r"\d{4,14}", date):
            continue
        length, begun = int(right[-1]), True
        block = data[at:at + length]
        at += length
        if not is_start:
            yield ArcRecord(b" ".join(fields[:-after]).decode("utf-8", "replace"), ip, date, mime, length, block,
                            len(block) < length)


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def write_archives(frame: DataFrame, path: str, end: str) -> None:
    """One file per row of ``frame`` (one string column), each closed by ``end``."""
    frame.write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of every archive below ``path``."""
    return (spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
            .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", uri_col: str = "url",
              payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write rows as ARC files of either version below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size, made = 1, [], 0, 0
        name = "part"
        for batch in batches:
            for key, uri, payload in zip(*(batch.column(c).to_pylist() for c in ("key", "uri", "payload")), strict=True):
                if not parts:
                    name = f"part-{made}.arc"
                    parts.append(version_block(version, name))
                    size = len(parts[0])
                moment = _EPOCH + timedelta(seconds=zlib.crc32(str(key).encode()) % 500_000_000)
                uri = re.sub(r"[\r\n]+", "", uri) or "about:blank"
                parts.append(arc_record(version, name, uri, key, moment.strftime("%Y%m%d%H%M%S"), payload, size))
                size += len(parts[-1]) + 1
                if size >= archive_bytes:
                    yield _strings([b"\n".join(parts)])
                    version, parts, made = 3 - version, [], made + 1
        if parts:
            yield _strings([b"\n".join(parts)])

    rows = pages.select(F.col(key_col).alias("key"), F.coalesce(uri_col, F.lit("")).alias("uri"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    write_archives(rows.mapInArrow(run, "value string"), path, "\n")


def _strings(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).view(pa.string())], ["value"])


# ---- ARC -> WARC -----------------------------------------------------------------------------

def record_id(archive: str, number: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}"


def warc_date(date: str) -> str:
    """ISO 8601 of an ARC date of 4 to 14 digits; what is missing is the earliest moment."""
    full = date + "00000101000000"[len(date):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC/1.1", None), *fields, ("Content-Length", str(len(block)))]
    head = "\r\n".join(k if v is None else f"{k}: {v}" for k, v in lines)
    return head.encode() + b"\r\n\r\n" + block


def converted(archive: str, data: bytes, refers: dict[int, str]) -> bytes:
    """The WARC file of an ARC file, without its last blank lines. ``refers``: for the records that
    repeat another's payload, by number, the id of the record they refer to."""
    out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(archive, -1)}>"),
                        ("WARC-Date", _EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Filename", archive),
                        ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
    for number, r in enumerate(parse_arc(data)):
        header, payload = r.parts()
        kind = "revisit" if number in refers else "response" if r.is_http else "resource"
        block = header if kind == "revisit" else r.block
        fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(archive, number)}>"),
                  ("WARC-Target-URI", r.uri), ("WARC-Date", warc_date(r.date)), ("WARC-IP-Address", r.ip),
                  ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
                  ("Content-Type", "application/http; msgtype=response" if r.is_http else r.mime)]
        if kind == "revisit":
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", f"<{refers[number]}>")]
        if r.truncated:
            fields.append(("WARC-Truncated", "length"))
        out.append(warc_record(fields, block))
    return b"\r\n\r\n".join(out)


def to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Convert all ARC files below ``arc_path`` to WARC files below ``warc_path``. Of payloads of
    at least ``min_bytes`` that are equal, the record with the largest key is the response."""
    archives = read_archives(spark, arc_path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                rows = []
                for number, r in enumerate(parse_arc(unpacked(content.as_py()))):
                    header, payload = r.parts()
                    key = header_field(header, KEY_HEADER) if r.is_http else None
                    if r.is_http and len(payload) >= min_bytes:
                        rows.append((name.as_py(), number, int(key) if key else None, sha1(payload)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in
                     enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], ["name", "number", "key", "digest"])

    # a small table of what the archives hold, read twice below
    with Scratch(spark) as scratch:
        listing = archives.mapInArrow(listed, "name string, number int, key long, digest string")
        _convert(archives, scratch.saved(listing, "arc-records"), warc_path)


def _convert(archives: DataFrame, records: DataFrame, warc_path: str) -> None:
    kept = (records.groupBy("digest").agg(F.max(F.struct("key", "name", "number")).alias("kept"), F.count("*").alias("n"))
            .where("n > 1").select("digest", "kept"))
    repeats = (records.join(kept, "digest")
               .where((F.col("name") != F.col("kept.name")) | (F.col("number") != F.col("kept.number")))
               .groupBy("name").agg(F.collect_list(F.struct(
                   "number", F.col("kept.name").alias("of"), F.col("kept.number").alias("at"))).alias("repeats")))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, own in zip(batch.column("name"), batch.column("content"), batch.column("repeats"), strict=True):
                refers = {r["number"]: record_id(r["of"], r["at"]) for r in own.as_py() or []}
                yield _strings([converted(name.as_py(), unpacked(content.as_py()), refers)])

    # an archive's repeats are bounded by its own records; the archives are dealt into partitions of bounded size
    size = archives.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    dealt = archives.repartition(partitions_for(archives.sparkSession, size, PARTITION_BYTES), "name")
    write_archives(dealt.join(repeats, "name", "left").mapInArrow(convert, "value string"), warc_path, "\r\n\r\n")


# ---- WARC ------------------------------------------------------------------------------------

def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        header = data[at:end]
        size = int(header_field(header, "Content-Length") or 0)
        yield header, data[end + 4:end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with a target: ids, type, uri, date, key, length and digest of the full
    payload (of a response those of its bytes as read; of a revisit the declared ones)."""
    names = ["record_id", "record_type", "target_uri", "warc_date", "key", "payload_bytes", "payload_digest", "refers_to_id",
             "digest_ok"]
    types = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for header, block in parse_warc(unpacked(content.as_py())):
                    kind = header_field(header, "WARC-Type")
                    if kind == "warcinfo":
                        continue
                    refers = header_field(header, "WARC-Refers-To")
                    http, payload = ArcRecord("", "", "", "", 0, block).parts()
                    key = header_field(http, KEY_HEADER)
                    declared = (header_field(header, "WARC-Payload-Digest") or "sha1:").split(":", 1)[1]
                    digest = declared if kind == "revisit" else sha1(payload)
                    size = int(header_field(http, "Content-Length") or 0) if kind == "revisit" else len(payload)
                    rows.append((header_field(header, "WARC-Record-ID").strip("<>"), kind, header_field(header, "WARC-Target-URI"),
                                 header_field(header, "WARC-Date"), int(key) if key else None, size, digest,
                                 refers.strip("<>") if refers else None, digest == declared))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    shape = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long' if t == pa.int64() else 'string'}" for n, t in
                      zip(names, types, strict=True))
    return read_archives(spark, path).mapInArrow(run, shape)


def archive_round_trip(pages: DataFrame, key_col: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Write ARC files of ``pages``, convert them to WARC, read those: one row per page."""
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        arc_path, warc_path = scratch.path("arc"), scratch.path("warc")
        write_arc(pages, arc_path, key_col)
        to_warc(spark, arc_path, warc_path, min_bytes)
        records = saved(read_warc(spark, warc_path), "warc-records")
    targets = (records.where("record_type <> 'revisit'")
               .select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to")))
    return records.join(targets, "refers_to_id", "left").select(
        F.col("key").alias(key_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok",
        "target_uri", "warc_date", "record_id")
