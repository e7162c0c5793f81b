"""Archives of web pages: legacy ARC files, and their conversion to WARC.

ARC files are read by the version that their first block states: its fields tell
how a header line is split (from the right, as addresses may hold spaces), and
the declared length how many bytes follow. From an ARC record the conversion
makes a WARC record: the identifier from file name and offset, so a repeated task
gives the same one; the time from the 14 (or 12) digits; the type from the
scheme; the digests of block and payload. Payloads that are equal and long
enough are kept once, as the response with the smallest page id; the others
become revisits that refer to it.

Files consist of one gzip member for each record. They are written by Spark's
text writer, one file for each row, so a lost task leaves no half files, on any
file system that Spark knows: every member ends in a zero byte, which is the
line separator. Files hold ``FILE_BYTES`` uncompressed bytes or one record.

Defined results: null pages have an empty payload; a null url is written as
``unknown:``; a null page id stays null, and counts as the largest; repeated rows
are records of their own; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failtriage.llm.common import store, texts
from failtriage.session import work_dir

FILE_BYTES = 32_000_000
LEVEL = 2
#: Shorter payloads are never revisits.
LEAST_REVISITED = 100
ARCHIVED = "20260101000000"
PAGE_ID = "X-Page-Id"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header fields of ARC records by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


# --- ARC ---


def arc_header(version: int, url: str, kind: str, length: int, name: str, status: str = "-", ip: str = "0.0.0.0") -> bytes:
    values = {"URL": url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D"), "IP-address": ip, "Archive-date": ARCHIVED}
    values |= {"Content-type": kind, "Archive-length": str(length), "Result-code": status, "Filename": name}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n"


def arc_version_block(version: int, name: str) -> bytes:
    block = f"{version} 0 Crawl\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_header(version, f"filedesc://{name}", "text/plain", len(block), name) + block + b"\n"


def arc_page(version: int, page_id: int | None, url: str | None, payload: bytes, name: str) -> bytes:
    own = "" if page_id is None else f"{PAGE_ID}: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
    return arc_header(version, url or "unknown:", "text/html", len(head) + len(payload), name, "200") + head + payload + b"\n"


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first; offsets are of the uncompressed file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    fields: tuple[str, ...] = ()
    while True:
        offset = stream.tell()
        line = stream.readline()
        if not line:
            return
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if not fields:
            if not line.startswith(b"filedesc://"):
                raise ValueError(f"no version block at the start: {line[:80]!r}")
            length = int(line.rpartition(b" ")[2])
            block = stream.read(length)
            version, *_ = block.split(b" ", 1)
            fields = ARC_FIELDS.get(int(version)) or tuple(block.splitlines()[1].decode().split())
        else:
            length = int(line.rpartition(b" ")[2])
            block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record at {offset}: {length} bytes declared, {len(block)} there")
        parts = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields):
            raise ValueError(f"record at {offset}: {len(parts)} fields instead of {len(fields)}")
        yield ArcRecord(offset, dict(zip(fields, parts)), block)


# --- WARC ---


def warc_date(digits: str) -> str:
    """ISO time of 14 or 12 digits; anything else is the start of 1970."""
    try:
        return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its empty line, and payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def http_field(head: bytes, name: str) -> str | None:
    start = name.lower().encode() + b":"
    for line in head.split(b"\r\n"):
        if line.lower().startswith(start):
            return line[len(start) :].strip().decode()
    return None


@dataclass
class Converted:
    record_id: str
    kind: str
    fields: list[tuple[str, str]]
    head: bytes
    payload: bytes

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.payload).digest()

    def record(self) -> bytes:
        block = self.head + self.payload
        extra = [("WARC-Payload-Digest", f"sha256:{self.digest.hex()}")] if self.kind == "response" else []
        return warc_record([("WARC-Type", self.kind), *self.fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), *extra], block)


def convert(name: str, arc: ArcRecord) -> Converted:
    """The WARC equivalent of an ARC record."""
    url = arc.fields["URL"]
    record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{arc.offset}')}"
    fields = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", warc_date(arc.fields["Archive-date"]))]
    if url.startswith("filedesc://"):
        info = f"software: archive converter\r\nformat: WARC File Format 1.1\r\nconverted-from: {url[11:]}\r\n".encode()
        return Converted(record_id, "warcinfo", [*fields, ("WARC-Filename", url[11:]), ("Content-Type", "application/warc-fields")], b"", info)
    fields += [("WARC-Target-URI", url), ("WARC-IP-Address", arc.fields.get("IP-address", ""))]
    if arc.block.startswith(b"HTTP/"):
        head, payload = http_parts(arc.block)
        return Converted(record_id, "response", [*fields, ("Content-Type", "application/http; msgtype=response")], head, payload)
    kind = "text/dns" if url.startswith("dns:") else arc.fields.get("Content-type", "application/octet-stream")
    return Converted(record_id, "resource", [*fields, ("Content-Type", kind)], b"", arc.block)


def revisit(fields: list[tuple[str, str]], head: bytes, digest: bytes, refers_to: str) -> bytes:
    extra = [("WARC-Payload-Digest", f"sha256:{digest.hex()}"), ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers_to}>")]
    block_digest = ("WARC-Block-Digest", f"sha256:{hashlib.sha256(head).hexdigest()}")
    return warc_record([("WARC-Type", "revisit"), *fields, block_digest, *extra], head)


@dataclass
class WarcRecord:
    fields: dict[str, str]
    block: bytes


def read_warc(content: bytes) -> Iterator[WarcRecord]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            fields[key.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{fields.get('warc-record-id')}: {length} bytes declared, {len(block)} there")
        yield WarcRecord(fields, block)


# --- Spark ---


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/failtriage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _files(parts: Iterator[tuple[int, bytes]], start: bytes) -> Iterator[bytes]:
    """File contents without their last byte, a zero; parts are members and their uncompressed sizes."""
    held, size = [start], 0
    for n, data in parts:
        if size and size + n > FILE_BYTES:
            yield _closed(held)
            held, size = [start], 0
        held.append(data)
        size += n
    if size:
        yield _closed(held)


def _closed(held: list[bytes]) -> bytes:
    content = b"".join(held)
    return content[:-1] if content[-1] == 0 else (content + member(b""))[:-1]


def _write(files: DataFrame, path: str) -> str:
    """Each row's ``content`` and a zero byte as a file."""
    text = files.select(F.col("content").cast("string").alias("value"))
    text.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str) -> str:
    """Pages (page_id, url, html) as ARC files, of version 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = f"pages-{part:06d}.arc.gz"

        def members() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "html")):
                    yield len(html) + 512, member(arc_page(version, page_id, url, html, name))

        for content in _files(members(), member(arc_version_block(version, name))):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return _write(rows.mapInArrow(run, "content binary"), path)


NARROW = "record_id string, page_id long, digest binary, payload_bytes long"
WHOLE = f"{NARROW}, fields map<string,string>, head binary, member binary"


def converted(files: DataFrame, whole: bool) -> DataFrame:
    """Records of ARC files as rows NARROW, or with what it takes to write them, WHOLE."""
    schema = WHOLE if whole else NARROW
    types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary()]
    names = [p.split()[0] for p in WHOLE.split(", ")][: 7 if whole else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for arc in read_arc(content.as_py()):
                    made = convert(path.as_py(), arc)
                    if made.kind == "warcinfo":
                        continue
                    page = http_field(made.head, PAGE_ID)
                    row = (made.record_id, None if page is None else int(page), made.digest, len(made.payload))
                    rows.append((*row, made.fields, made.head, member(made.record())) if whole else row)
                    size += len(made.payload) if whole else 100
                    if size > FILE_BYTES // 4:
                        yield batched(rows)
                        rows, size = [], 0
                if rows:
                    yield batched(rows)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.mapInArrow(run, schema)


def write_warc(arc_path: str, path: str, spark: SparkSession) -> str:
    """ARC files as WARC files, equal payloads once."""
    files = _contents(spark, arc_path)
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")
    first = converted(files, whole=False).where(F.col("payload_bytes") >= LEAST_REVISITED)
    first = first.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = store(first.select("digest", F.col("first.record_id").alias("refers_to")), "first-payloads")
    rows = converted(files, whole=True).join(first, "digest", "left").select(
        "record_id", "digest", "fields", "head", "member", "payload_bytes", "refers_to"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        info = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
        start_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo-{part}')}>"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", start_id), ("WARC-Date", warc_date(ARCHIVED)), ("Content-Type", "application/warc-fields")]

        def members() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["refers_to"] in (None, row["record_id"]):
                        yield row["payload_bytes"] + 1024, row["member"]
                    else:
                        yield 1024, member(revisit(list(row["fields"]), row["head"], row["digest"], row["refers_to"]))

        for content in _files(members(), member(warc_record(fields, info))):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    return _write(rows.mapInArrow(run, "content binary"), path)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, url string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of WARC files as rows READ; payloads are checked against their digests."""
    names = [p.split()[0] for p in READ.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for record in read_warc(content.as_py()):
                    kind = record.fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = http_parts(record.block)
                    digest = record.fields["warc-payload-digest"].removeprefix("sha256:")
                    length = int(http_field(head, "Content-Length"))
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{record.fields['warc-record-id']}: payload does not match its digest or length")
                    page = http_field(head, PAGE_ID)
                    refers = record.fields.get("warc-refers-to")
                    rows.append((None if page is None else int(page), length, digest, kind, record.fields["warc-record-id"], refers, record.fields.get("warc-target-uri")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return _contents(spark, path).mapInArrow(run, READ)


def archive(pages: DataFrame) -> DataFrame:
    """Write pages as ARC, convert to WARC, and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    arc = write_arc(pages, _folder(spark, "arc"))
    path = write_warc(arc, _folder(spark, "warc"), spark)
    records = store(read_records(spark, path), "records")
    target = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(target, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
