"""Media columns in a content-defined chunk store.

A payload is kept as a WAV file of 8-bit samples. A rolling gear hash cuts the file where the hash of the last 32
bytes has its top bits clear, so equal passages give equal chunks wherever they stand. Chunk
digests (not chunks) are shuffled: Spark joins find each digest's home, the first medium and position
that has it. Then the media are cut again where they lie, and each chunk is written once, by its home:

* a chunk that one place uses goes into its medium's row, compressed with its neighbours;
* a chunk that several places use goes into the table of shared chunks, once.

Equal media are stored once, by the first document that has them. Reading is a join of the
ordered chunk lists with the shared chunks, for the media that have such chunks; all other media are
whole in their row. Each chunk is verified by its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, table

UNIT = 64
LEAST, MOST, CUT_BITS = 512, 16_384, 11
RATE = 8000
#: Gear values come from the mixer, not from a list.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
BLOCK = 1 << 20
#: Media that share chunks or repeat others may be broadcast to the writers up to so many rows (about 60 bytes) and positions (4 bytes).
SHARING_BROADCAST, POSITIONS_BROADCAST = 400_000, 8_000_000

LISTS = "media_id binary, doc_id long, key string, n_bytes long, digests array<binary>"
LISTS_ARROW = pa.schema([("media_id", pa.binary()), ("doc_id", pa.int64()), ("key", pa.string()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.binary()))])
STORED = "kind string, media_id binary, digests array<binary>, shared array<int>, lengths array<int>, bytes binary"
STORED_ARROW = pa.schema([("kind", pa.string()), ("media_id", pa.binary()), ("digests", pa.list_(pa.binary())), ("shared", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("bytes", pa.binary())])
READ = "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
READ_ARROW = pa.schema([("media_id", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def payload_of(text: bytes | None) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def to_wav(samples: bytes) -> bytes:
    """RIFF/WAVE, one channel of unsigned 8-bit samples; an even number of them needs no padding."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples


def from_wav(wav: bytes) -> bytes:
    if wav[:4] != b"RIFF" or wav[36:40] != b"data":
        raise ValueError("not a WAV file of 8-bit samples")
    return wav[44 : 44 + struct.unpack_from("<I", wav, 40)[0]]


def gear_marks(data: np.ndarray) -> np.ndarray:
    """Ends of bytes at which the rolling hash asks for a cut. Doubling sums 32 shifted gear values in five steps."""
    found = []
    for at in range(0, len(data), BLOCK):
        lead = min(at, 31)
        h = GEAR[data[at - lead : at + BLOCK]]
        for k in (1, 2, 4, 8, 16):
            g = h.copy()
            g[k:] += h[:-k] << np.uint32(k)
            h = g
        found.append(np.flatnonzero(h[lead:] < np.uint32(1 << (32 - CUT_BITS))) + (at + 1))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cut(lengths: list[int], data: bytes) -> list[list[int]]:
    """Chunk ends of each medium; media lie one after the other in data. No chunk is under LEAST bytes (but a
    medium's last), so a hash that decides a cut covers bytes of its own medium only."""
    marks, out, start = gear_marks(np.frombuffer(data, np.uint8)), [], 0
    for n in lengths:
        own = (marks[np.searchsorted(marks, start, "right") : np.searchsorted(marks, start + n)] - start).tolist()
        ends, at = [], 0
        for m in own:
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST:
                at = m
                ends.append(at)
        while n - at > MOST:
            at += MOST
            ends.append(at)
        if at < n:
            ends.append(n)
        out.append(ends)
        start += n
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunked(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(row, chunks, digests) for each text; small media are cut together."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(to_wav(payload_of(text)))
        size += len(held[-1])
        if size >= BLOCK or i + 1 == len(texts):
            for k, ends in enumerate(cut([len(x) for x in held], b"".join(held))):
                chunks = [held[k][a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield first + k, chunks, [digest(c) for c in chunks]
            held, size, first = [], 0, i + 1


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, texts = (c.to_pylist() for c in batch.columns)
        media, sizes, lists = [], [], []
        for i, _, digests in _chunked(texts):
            media.append(digest(b"".join(digests)))
            sizes.append(len(texts[i] or b""))
            lists.append(digests)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((media, ids, keys, sizes, lists), LISTS_ARROW.types, strict=True)], schema=LISTS_ARROW)


def _writer(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            texts, shared, home = (c.to_pylist() for c in batch.columns)
            rows, held = [], 0
            for i, chunks, digests in _chunked(texts):
                elsewhere, ours = set(shared[i] or ()), home[i] or ()
                rows += [("chunk", None, [digests[p]], None, [len(chunks[p])], compress(chunks[p])) for p in ours]
                own = b"".join(c for p, c in enumerate(chunks) if p not in elsewhere)
                rows.append(("medium", digest(b"".join(digests)), digests, sorted(elsewhere), [len(c) for c in chunks], compress(own)))
                held += len(rows[-1][5])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), STORED_ARROW.types, strict=True)], schema=STORED_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), STORED_ARROW.types, strict=True)], schema=STORED_ARROW)

    return run


def features(samples: bytes) -> str:
    """Of 8-bit samples around 128: mean, RMS, share of sign changes and the histogram of the upper four bits."""
    x = np.frombuffer(samples, np.uint8)
    c = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((c[1:] < 0) != (c[:-1] < 0)))
    bars = np.bincount(x >> 4, minlength=16)
    return f"mean={c.mean():.4f};rms={np.sqrt((c.astype(np.float64) ** 2).mean()):.4f};zcr={crossings / max(1, len(x) - 1):.5f};hist=" + ",".join(f"{b / len(x):.4f}" for b in bars)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for media_id, digests, shared, lengths, own, fetched in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            elsewhere = {f["pos"]: f["bytes"] for f in fetched or ()}
            away = set(shared)
            own = expand.decompress(own, max_output_size=max(1, sum(n for p, n in enumerate(lengths) if p not in away)))
            chunks, at = [], 0
            for p, n in enumerate(lengths):
                if p in away:
                    chunks.append(expand.decompress(elsewhere[p], max_output_size=n))
                else:
                    chunks.append(own[at : at + n])
                    at += n
                if digest(chunks[-1]) != digests[p]:
                    raise ValueError("a chunk differs from its digest")
            wav = b"".join(chunks)
            payload = from_wav(wav)
            out.append((media_id, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), features(payload)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), READ_ARROW.types, strict=True)], schema=READ_ARROW)


def store_media(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, media, chunks): the ordered chunk list of every row, each distinct medium once, each shared chunk once.

    Null texts are empty payloads; ids are whole numbers or cast to them (what can't be is an error), and rows may repeat ids, texts or both. An empty table gives empty tables.
    """
    data = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.md5(data).alias("key"), data.alias("data"))
    lists = scratch.save(rows.mapInArrow(_lists, LISTS), "lists")
    first = lists.groupBy("media_id").agg(F.min(F.struct("doc_id", "key")).alias("h"), F.count(F.lit(1)).alias("copies"))
    first = first.select("media_id", F.col("h.doc_id").alias("home_doc"), F.col("h.key").alias("home_key"), "copies")
    homes = lists.join(first, "media_id").where(F.col("doc_id").eqNullSafe(F.col("home_doc")) & (F.col("key") == F.col("home_key")))
    places = homes.select("media_id", F.posexplode("digests").alias("pos", "digest")).distinct()
    homes_of = places.groupBy("digest").agg(F.min(F.struct("media_id", "pos")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refs = places.join(homes_of, "digest").select("media_id", "pos", "digest", (F.struct("media_id", "pos") == F.col("at")).alias("is_home"))
    marks = refs.groupBy("media_id").agg(F.sort_array(F.collect_list("pos")).alias("shared"), F.sort_array(F.collect_list(F.when(F.col("is_home"), F.col("pos")))).alias("home"))
    # what a writer has to know of a document: nothing for most; a copy of an earlier one; positions of shared chunks
    known = lists.select("media_id", "doc_id", "key").join(first, "media_id").join(marks, "media_id", "left")
    skip = ~(F.col("doc_id").eqNullSafe(F.col("home_doc")) & (F.col("key") == F.col("home_key")))
    known = known.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), skip.alias("_skip"), "shared", "home").where("_skip OR shared IS NOT NULL").distinct()
    known = scratch.save(known, "known")
    n, positions = known.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("shared"), F.lit(0)) + F.greatest(F.size("home"), F.lit(0)))).first()
    known = F.broadcast(known) if n <= SHARING_BROADCAST and (positions or 0) <= POSITIONS_BROADCAST else known
    todo = rows.join(known, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left").where(~F.coalesce("_skip", F.lit(False)))
    path = f"{scratch.root}/store"
    todo.select("data", "shared", "home").mapInArrow(_writer(level), STORED).write.partitionBy("kind").parquet(path)
    stored = docs.sparkSession.read.schema(STORED.replace("kind string, ", "") + ", kind string").parquet(path)
    media = stored.where("kind = 'medium'").drop("kind")
    chunks = stored.where("kind = 'chunk'").select(F.element_at("digests", 1).alias("digest"), "bytes")
    if _repeats(lists):
        media, chunks = media.dropDuplicates(["media_id"]), chunks.dropDuplicates(["digest"])
    return lists, media, chunks


def _repeats(lists: DataFrame) -> bool:
    """True if some row repeats both id and text: its medium is then written more than once."""
    return not lists.groupBy("doc_id", "key").count().where("count > 1").isEmpty()


def read_media(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rebuilds every medium from its ordered chunk list, verifies it and computes its features."""
    fetched = "array<struct<pos:int,bytes:binary>>"
    cols = ["media_id", "digests", "shared", "lengths", "bytes"]
    whole = media.where(F.size("shared") == 0).select(*cols, F.lit(None).cast(fetched).alias("fetched"))
    parts = media.where(F.size("shared") > 0)
    refs = parts.select("media_id", F.explode("shared").alias("pos"), "digests").select("media_id", "pos", F.element_at("digests", F.col("pos") + 1).alias("digest"))
    got = refs.join(chunks, "digest").groupBy("media_id").agg(F.collect_list(F.struct("pos", "bytes")).alias("fetched"))
    return whole.unionByName(parts.select(*cols).join(got, "media_id")).mapInArrow(_reader, READ)


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    lists, media, chunks = store_media(table(spark, sf_dir, "documents"), scratch)
    return lists.select("doc_id", "n_bytes", "media_id").join(read_media(media, chunks), "media_id").drop("media_id")


QUERIES = {"op8_media_chunks": op8_media_chunks}
