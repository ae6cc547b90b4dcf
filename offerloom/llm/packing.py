"""Token ids in packed rows: best-fit-decreasing packing with a segment tree over capacities.

Each task tokenises its documents, cuts those longer than a row losslessly into pieces, and packs the
pieces of a bounded buffer best-fit-decreasing: the longest piece first, each into the fullest row
that still takes it. A segment tree over the capacities 0..row_length finds that row in log(row_length)
steps. Rows that stay too empty when a buffer is packed go back into the next buffer, so only a
task's last rows may be loose. No shuffle is needed: packing doesn't care which documents meet.

A packed row holds the id matrix's row (little-endian, padded), the cumulative segment lengths
(0 first, the used length last), the positions at which position ids restart at 0, and for each
segment its document, the copy (a number that tells the rows of one id apart), the piece's number
and the token offset in the document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, table, trimmed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before its byte pairs are merged; has to be this pattern for the vocabulary above.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW_LENGTH = 2048
BUFFER_TOKENS = 2_000_000
LOOSE = 0.03

PACKED = "ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, copies array<long>, pieces array<int>, offsets array<long>"
ARROW = pa.schema(
    [("ids", pa.binary()), ("n_tokens", pa.int32())]
    + [(n, pa.list_(pa.int32())) for n in ("cu_seqlens", "position_resets")]
    + [("doc_ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))]
)


class Tokens:
    """Text -> token ids as bytes of the narrowest type that holds them, the end-of-document id last."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.end_bytes = np.array([self.end], self.dtype).tobytes()

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def of(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes() + self.end_bytes


_LOADED: dict[str, Tokens] = {}


def tokens(vocabulary: str) -> Tokens:
    """The tokeniser of a file, loaded once in a worker. A file shipped with ``addFile`` is named by its bare name."""
    if vocabulary not in _LOADED:
        from pyspark import SparkFiles

        _LOADED[vocabulary] = Tokens(vocabulary if "/" in vocabulary else SparkFiles.get(vocabulary))
    return _LOADED[vocabulary]


class CapacityTree:
    """Counts of rows by capacity left; finds the smallest capacity that is at least n."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def best(self, n: int) -> int:
        """-1 if no row has room."""
        count, at = self.count, n + self.leaves
        if count[at]:
            return n
        while at > 1:  # up to the first right neighbour that has rows
            if not at & 1 and count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return -1
        while at < self.leaves:  # down to its smallest capacity
            at *= 2
            if not count[at]:
                at += 1
        return at - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; equal lengths keep their order."""
    tree, rows, by_capacity = CapacityTree(capacity), [], [[] for _ in range(capacity + 1)]
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[piece]
        room = tree.best(n)
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = by_capacity[room].pop()
            tree.add(room, -1)
        rows[row].append(piece)
        by_capacity[room - n].append(row)
        tree.add(room - n, 1)
    return rows


def _pack(vocabulary: str, row_length: int, buffer_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(vocabulary)
        wide = t.dtype.itemsize
        pieces, held = [], 0  # (doc_id, copy, number, ids)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pieces, held
            out, loose = [], []
            for row in best_fit_decreasing([len(p[3]) // wide for p in pieces], row_length):
                ids = b"".join(pieces[i][3] for i in row)
                n = len(ids) // wide
                if not last and n < row_length * (1 - LOOSE):
                    loose += row
                    continue
                ends = np.cumsum([0] + [len(pieces[i][3]) // wide for i in row]).tolist()
                own = [pieces[i] for i in row]
                out.append(
                    {"ids": ids + t.end_bytes * (row_length - n), "n_tokens": n, "cu_seqlens": ends, "position_resets": ends[:-1],
                     "doc_ids": [p[0] for p in own], "copies": [p[1] for p in own], "pieces": [p[2] for p in own], "offsets": [p[2] * row_length for p in own]}
                )
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)
            pieces = [pieces[i] for i in loose]
            held = sum(len(p[3]) // wide for p in pieces)

        for batch in by_bytes(batches):
            for doc_id, text, copy in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = t.of(text or "")
                n = len(ids) // wide
                for k, at in enumerate(range(0, n, row_length)):
                    pieces.append((doc_id, copy, k, ids[at * wide : (at + row_length) * wide]))
                held += n
                if held >= buffer_tokens:
                    yield from flush(False)
        if pieces:
            yield from flush(True)

    return run


def pack_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, row_length: int = ROW_LENGTH, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Packed rows of all documents; every token of every document is in exactly one of them.

    Null and empty texts are the end-of-document id alone. A document longer than a row is cut into
    pieces of row_length ids. Ids are whole numbers (or cast to them), may be null and may repeat: ``copies`` numbers the input's rows. The
    vocabulary is a path that every executor has, or the bare name of a file sent by ``SparkContext.addFile``. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("copy"))
    return rows.mapInArrow(trimmed(_pack(vocabulary, row_length, buffer_tokens)), PACKED)


def id_matrix(rows: list, wide: int = 2) -> np.ndarray:
    """The id matrix of some packed rows."""
    return np.stack([np.frombuffer(r["ids"], f"<u{wide}") for r in rows])


def position_ids(cu_seqlens: list[int], row_length: int) -> np.ndarray:
    """0, 1, 2, ... restarting at each segment, and over the padding."""
    starts = np.zeros(row_length, np.int64)
    for s in cu_seqlens:
        if s < row_length:
            starts[s] = s
    return np.arange(row_length) - np.maximum.accumulate(starts)


def op3_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_pack": op3_token_pack}
