"""Small helpers that the training-data operators share: tables, scratch tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one in local mode; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="offerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Python tasks get texts in Arrow batches of 4 MB, unless the session has another bound than Spark's default of 64 MB: a batch is in memory
    twice, in the executor and in its worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, str(64 << 20)).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(4 << 20))


#: Bytes of a row group of scratch tables: what a writer holds in memory.
ROW_GROUP = 16 << 20


class Scratch:
    """Tables written to the shared folder, to cut lineage where several later steps read a result.

    A table that is lost with an executor isn't lost here: it is on shared storage. ``drop`` frees
    a table as soon as the last step that reads it has been written itself.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast only after the row count has been checked; otherwise the join stays a shuffle join."""
    return F.broadcast(df) if small(df, rows) else df


def fresh(columns: list[str], name: str) -> str:
    """A name that no column has yet, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches, rows: int = 500):
    """Arrow batches in slices, so that only few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batches, column: int = 1, size: int = 1 << 19):
    """Arrow batches in slices whose texts have about so many bytes; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def gathered(batches, size: int):
    """Arrow batches put together to about so many bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def trimmed(run):
    """A task function for mapInArrow or applyInArrow after which the worker gives free memory back: workers are used again by
    other tasks and stages, and share their executor's memory limit."""
    import inspect

    def trim() -> None:
        import ctypes
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            return

    if inspect.isgeneratorfunction(run):

        def task(batches):
            try:
                yield from run(batches)
            finally:
                trim()
    else:

        def task(part):
            try:
                return run(part)
            finally:
                trim()

    task.__annotations__ = run.__annotations__
    return task


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that combined hashes are spread evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; order matters. Hashes of 1, 2, 4, ... words are put together."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, size, done, out = words, 1, 0, None
    while True:
        if k & size:
            piece = part[done : done + n]
            out = piece if out is None else mix64(out * np.uint64(3) + piece)
            done += size
        if done == k:
            return mix64(out)
        part = mix64(part[: len(part) - size] * np.uint64(5) + part[size:])
        size *= 2


#: Bytes that part words: the space and \t \n \v \f \r.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FOLDED = np.arange(256)
_FOLDED[ord("A") : ord("Z") + 1] += 32
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BLOCK = 1 << 19


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; kept up to one block."""
    if n <= len(_POWERS[0]):
        return _POWERS
    size = max(n, min(_BLOCK, 4 * n))
    out = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    if size <= _BLOCK:
        _POWERS[:] = out
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of disjoint spans of bytes in order, all at once: a polynomial over the bytes, from sums up to each place. fold: A-Z count as a-z."""
    values = _BYTES[_FOLDED] if fold else _BYTES
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        first = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
        part = data[first : ends[stop - 1]]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=total[1:])
        a, b = starts[k:stop] - first, ends[k:stop] - first
        out[k:stop] = mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        k = stop
    return out


class Words(NamedTuple):
    """Words of several texts: text i has those from first[i] to first[i + 1]; a word is data[start:end]."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def words_of(texts: pa.Array, fold: bool = False, spaces: np.ndarray = SPACES) -> Words:
    """The words of texts (strings or bytes; null: none) with their hashes, without a Python object for any of them."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    inside = ~spaces[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    at, to = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[at], stops[to] = inside[at], inside[to]  # words end with their text
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(span_hashes(data, starts, ends, fold), np.searchsorted(starts, offsets), starts, ends, data)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    s = np.sort(values)
    keep = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]
