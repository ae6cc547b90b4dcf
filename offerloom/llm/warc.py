"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is its frames followed by the
seek table of the seekable format in a skippable frame (compressed and decompressed size of each
frame, then the footer), so a reader can decompress the one frame that it needs. Beside each bundle
lies its index: record id -> frame and offset within the decompressed frame.

Bundles are rows of a Parquet table (bundle_id, index, bytes): Spark's commit protocol keeps or
drops a task's bundles as a whole, on any store, when executors are lost and tasks run again. ``bytes``
is a complete ``.warc.zst`` file and can be copied out as it is.

A record is a revisit if a page with a smaller id has an equal payload. Only digests are shuffled
to find that out; the pages themselves stay where they are as long as the list of revisits is small
enough to broadcast, and are joined by shuffle beyond that.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, table

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISITS_BROADCAST = 300_000

BUNDLE = "bundle_id string, n_records long, index array<struct<record_id:string,page_id:long,frame:int,offset:long>>, bytes binary"
INDEX_TYPE = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64())]))
BUNDLE_ARROW = pa.schema([("bundle_id", pa.string()), ("n_records", pa.int64()), ("index", INDEX_TYPE), ("bytes", pa.binary())])
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header only; digest and length are the full payload's."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, decompressed) sizes and the footer of the seekable format."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(position, compressed size, decompressed size) of each frame."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    out, at, table_at = [], 0, len(bundle) - 9 - 8 * n
    for k in range(n):
        c, d = struct.unpack_from("<II", bundle, table_at + 8 * k)
        out.append((at, c, d))
        at += c
    return out


class _Bundle:
    def __init__(self, level: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames, self.sizes, self.index, self.open, self.open_bytes, self.bytes = [], [], [], [], 0, 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.index.append({"record_id": record_id(page_id), "page_id": page_id, "frame": len(self.frames), "offset": self.open_bytes})
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def row(self) -> pa.RecordBatch:
        self.close_frame()
        data = b"".join(self.frames) + seek_table(self.sizes)
        return pa.RecordBatch.from_pylist([{"bundle_id": hashlib.sha1(data).hexdigest(), "n_records": len(self.index), "index": self.index, "bytes": data}], schema=BUNDLE_ARROW)


def _bundles(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = _Bundle(level)
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                bundle.add(page_id, warc_record(page_id, url, payload, refers_to, revisit))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield bundle.row()
                    bundle = _Bundle(level)
        if bundle.index:
            yield bundle.row()

    return run


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of the record that starts at this offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    fields = dict((k.lower(), v) for k, v in (x.split(": ", 1) for x in lines[1:]))
    return fields, data[end + 4 : end + 4 + int(fields["content-length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for index, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            frames, held, out = read_seek_table(data), (-1, b""), []
            for entry in index:
                if held[0] != entry["frame"]:
                    at, size, full = frames[entry["frame"]]
                    held = (entry["frame"], expand.decompress(data[at : at + size], max_output_size=full))
                f, block = parse_record(held[1], entry["offset"])
                if f["warc-record-id"] != entry["record_id"]:
                    raise ValueError("index and archive differ")
                http, _, payload = block.partition(b"\r\n\r\n")
                n, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), f["warc-payload-digest"].removeprefix("sha1:")
                revisit = f["warc-type"] == "revisit"
                if not revisit and (len(payload) != n or sha1_base32(payload) != digest):
                    raise ValueError("payload differs from its digest")
                page, refers = f.get("x-page"), f.get("x-refers-to-page")
                out.append({"page_id": page and int(page), "payload_bytes": n, "payload_digest": digest, "record_type": f["warc-type"], "refers_to": refers and int(refers), "target_uri": f["warc-target-uri"]})
            yield pa.RecordBatch.from_pylist(out, schema=PAGE_ARROW)


def write_bundles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, level: int = 3) -> DataFrame:
    """Bundle rows (bundle_id, n_records, index, bytes) of one WARC record for each row of pages.

    Null payloads are empty; a null url becomes ``urn:page:ID``. Of records with equal payloads of at
    least min_revisit_bytes the one with the smallest id is the response, the others revisit it; a
    null id (its URL then ``urn:page:None``) counts as larger than all; ids are whole numbers or cast to them, what can't be is an error. Rows that repeat both id and payload are all responses
    or all revisits. Payloads of any length are one record in one frame. An empty table gives no bundle.
    """
    payload = F.coalesce(pages[html_col].cast("binary"), F.lit(b""))
    p = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"))
    ids = p.where(F.length("payload") >= min_revisit_bytes).select("page_id", F.sha1("payload").alias("digest"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    again = ids.join(first.drop("n"), "digest").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    again = broadcast_if(Scratch(pages.sparkSession, "revisits").save(again, "again"), REVISITS_BROADCAST)
    roles = p.withColumn("digest", F.sha1("payload")).join(again, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    return roles.select("page_id", "url", "payload", "refers_to", F.col("_digest").isNotNull().alias("revisit")).mapInArrow(_bundles(level), BUNDLE)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    return bundles.select("index", "bytes").mapInArrow(_read, PAGE)


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = Scratch(spark, "warc").save(write_bundles(table(spark, sf_dir, "pages")), "bundles")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc_bundles": op6_warc_bundles}

ORACLES = {
    "op6_warc_bundles": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INTEGER), 5))::BIGINT // CAST(pow(32, 3 - k % 4) AS BIGINT)) % 32 + 1 AS INTEGER), 1), '' ORDER BY k) AS digest
      FROM (SELECT DISTINCT h FROM p), range(32) AS r(k) GROUP BY h),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN b USING (h) JOIN f USING (h)
""",
}
