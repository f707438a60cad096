"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Pages of equal payload (1000 bytes or more) are stored once, by the page of largest id; the others become
revisit records that refer to it. The reader takes a file as a stream: compressed bytes go through an
incremental decompressor, a record's block is framed by its content length, a member must end with its
record, and block and payload digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import Stages, open_input, open_output, task

LEAST_BYTES = 1000
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 16
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value without line breaks or other controls."""
    return "".join(f"%{ord(ch):02X}" if ord(ch) < 0x20 or ord(ch) == 0x7F else ch for ch in value)


def record(kind: str, record_id: str, date: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    """One record as a gzip member of its own."""
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *more,
        ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if url is not None:
        more.append(("WARC-Target-URI", url))
    name = f"urn:page:{'none' if page_id is None else page_id}"
    if refers_to is None:
        return record("response", name, date, http + payload, more)
    more += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return record("revisit", name, date, http, more)


# ---- writing -------------------------------------------------------------------------------------


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per row into archives below `folder`; returns the staged list of files: `path`,
    `records`, `bytes`. Only files of committed tasks are listed.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of 1000 bytes or more, those
    of the largest id are responses (repeated rows of that id all are), the others revisits; rows without an
    id are responses unless another row holds their payload. Other columns are not read.
    """
    c = F.col
    rows = pages.select(
        c(page_id).cast("bigint").alias("page_id"),
        c(url).cast("string").alias("url"),
        F.coalesce(c(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Who holds a payload is found without the payloads; these then meet it by digest and id, so that a page that
    # many rows repeat is no single key.
    large = rows.where(c("size") >= LEAST_BYTES).select("page_id", "digest")
    holders = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where(c("n") > 1)
    key = F.concat_ws(":", "digest", c("page_id").cast("string"))
    held = large.distinct().join(holders.drop("n"), "digest").where(c("holder").isNotNull() & ~c("holder").eqNullSafe(c("page_id")))
    # Small payloads get a key that matches nothing.
    keyed = rows.withColumn("key", F.when(c("size") >= LEAST_BYTES, key).otherwise(F.concat(F.lit("small-"), key)))
    placed = keyed.join(held.select(key.alias("key"), "holder"), "key", "left")
    revisit = c("holder").isNotNull()
    placed = placed.select(
        "page_id", "url", F.when(~revisit, c("payload")).alias("payload"), "size", "digest", F.when(revisit, c("holder")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, count, size = None, "", 0, 0

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

        for batch in batches:
            for number, where, payload, full, digest, refers in zip(*(x.to_pylist() for x in batch.columns)):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, count = open_output(path), 0
                    info = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")])
                    size = out.write(info)
                size += out.write(page_record(number, where, payload or b"", full, digest, refers, date))
                count += 1
                if size >= FILE_BYTES:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    files = placed.mapInArrow(task(run), "path string, records bigint, bytes bigint")
    return Stages(pages.sparkSession, "archives").keep(files, "files")


# ---- reading -------------------------------------------------------------------------------------


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        lines = head.decode("latin-1").split("\r\n")[1:]
        return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}, body


class BadArchive(ValueError):
    """The archive is cut short, framed wrongly or fails a digest."""


def records(stream) -> Iterator[Record]:
    """The records of one archive, in order. Holds one record and one read buffer at a time."""
    buffer, offset = b"", 0
    while buffer or (buffer := stream.read(READ_BYTES)):
        unpack = zlib.decompressobj(31)
        data, used = bytearray(), 0
        length = head_end = None
        while not unpack.eof:
            if not buffer and not (buffer := stream.read(READ_BYTES)):
                raise BadArchive(f"offset {offset}: the member is cut short")
            try:
                data += unpack.decompress(buffer)
            except zlib.error as e:
                raise BadArchive(f"offset {offset}: {e}") from e
            used += len(buffer) - len(unpack.unused_data)
            buffer = unpack.unused_data
            if head_end is None and (at := data.find(b"\r\n\r\n")) >= 0:
                head_end, headers = at + 4, _headers(bytes(data[:at]), offset)
                length = int(headers["content-length"])
            if head_end is not None and len(data) > head_end + length + 4:
                raise BadArchive(f"offset {offset}: more than one record in a member")
        if head_end is None or len(data) != head_end + length + 4 or data[-4:] != b"\r\n\r\n":
            raise BadArchive(f"offset {offset}: the block is not as long as stated")
        found = Record(headers, bytes(data[head_end:-4]), offset)
        _verify(found)
        yield found
        offset += used


def _headers(head: bytes, offset: int) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise BadArchive(f"offset {offset}: no WARC version line")
    out = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    if not {"warc-type", "warc-record-id", "content-length"} <= out.keys():
        raise BadArchive(f"offset {offset}: a needed header is missing")
    return out


def _verify(found: Record) -> None:
    stated = found.headers.get("warc-block-digest")
    if stated and stated != _digest(found.block):
        raise BadArchive(f"offset {found.offset}: wrong block digest")
    stated = found.headers.get("warc-payload-digest")
    if stated and found.kind == "response" and stated != _digest(found.http()[1]):
        raise BadArchive(f"offset {found.offset}: wrong payload digest")


def read_archives(files: DataFrame) -> DataFrame:
    """The page records of listed archives (`path`): `record_id`, `record_type`, `target_uri`, `payload` (null
    for revisits), `payload_bytes` and `payload_digest` (of the full payload), `refers_to` (a record id),
    `path` and `offset`. A damaged archive fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_input(path) as stream:
                    for found in records(stream):
                        if found.kind not in ("response", "revisit"):
                            continue
                        http, body = found.http()
                        h = found.headers
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        whole = found.kind == "response"
                        refers = h.get("warc-refers-to")
                        rows.append(
                            (h["warc-record-id"][1:-1], found.kind, h.get("warc-target-uri"), body if whole else None,
                             len(body) if whole else int(http["content-length"]), digest, refers and refers[1:-1], path, found.offset)
                        )
                        size += len(body)
                        if size >= BATCH_BYTES:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    spread = files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(task(run), _SCHEMA)


_SCHEMA = (
    "record_id string, record_type string, target_uri string, payload binary, payload_bytes bigint, "
    "payload_digest string, refers_to string, path string, offset bigint"
)
_KINDS = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), _KINDS)], names=names)


def page_of(name: str):
    """The page id in a record id; null where it is none."""
    return F.expr(f"try_cast(substring({name}, 10) AS bigint)")
