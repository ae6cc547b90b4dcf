"""Vector code compression: product quantisation with exact integer codebooks, trained by a tree aggregation.

Vectors are cut into equal parts, and each part position has a codebook. A round gives every part to its nearest entry and moves each entry to the mean
of its parts. Rounds are ``RDD.treeAggregate`` over columnar NumPy blocks (``vectors``): a task adds up squared distances dimension
by dimension for all entries at once, takes the nearest entry (the lower index on ties), and adds its parts with ``np.add.at`` to
int64 tensors of sums and counts, which are merged through a tree of reducers. A tensor has parts x entries x width numbers,
whatever the input's size; that and the codebooks are all that passes through the driver. Sums are whole numbers, so the order of merging
doesn't matter, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, broadcast_if, table
from .vectors import blocks_of, main_length, unpack

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose distances to all entries are in memory at a time.
STEP = 2048
#: Sums by label may be broadcast up to so many rows (two numbers or a short label each).
LABELS_BROADCAST = 200_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column of x, (width, n), for a book (width, entries); distances grow dimension by dimension."""
    entry, least = np.empty(x.shape[1], np.int64), np.empty(x.shape[1], np.int64)
    for at in range(0, x.shape[1], STEP):
        part = x[:, at : at + STEP].astype(np.int64)
        far = np.zeros((book.shape[1], part.shape[1]), np.int64)
        for d in range(len(book)):
            gap = part[d] - book[d][:, None]
            gap *= gap
            far += gap
        entry[at : at + STEP] = far.argmin(axis=0)
        least[at : at + STEP] = np.take_along_axis(far, entry[None, at : at + STEP], 0)[0]
    return entry, least


def _adder(books):
    """Adds a block to (sums, counts): (parts, width, entries) and (parts, entries)."""

    def add(held, row):
        codebooks = books.value
        parts, width, entries = codebooks.shape
        if held is None:
            held = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        sums, counts = held
        x = unpack(row["data"], row["wide"], parts * width, row["n"])
        for p in range(parts):
            own = x[p * width : (p + 1) * width]
            entry, _ = nearest(own, codebooks[p])
            np.add.at(counts[p], entry, 1)
            for d in range(width):
                np.add.at(sums[p, d], entry, own[d].astype(np.int64))
        return held

    return add


def _merge(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def train(blocks: DataFrame, start: np.ndarray, rounds: int, depth: int = 2) -> np.ndarray:
    """Codebooks (parts, width, entries) after so many rounds; entries without parts stay."""
    codebooks, sc = start, blocks.sparkSession.sparkContext
    rdd = blocks.select("n", "wide", "data").rdd
    for _ in range(rounds):
        books = sc.broadcast(codebooks)
        held = rdd.treeAggregate(None, _adder(books), _merge, depth)
        books.unpersist()
        if held is None:
            break
        sums, counts = held
        codebooks = np.where(counts[:, None, :] > 0, sums // np.maximum(counts, 1)[:, None, :], codebooks)
    return codebooks


def _first_vectors(blocks: DataFrame, dims: int, n: int) -> np.ndarray:
    """The vectors with the n smallest ids (equal ids: by their components), (dims, n). Each block gives its n smallest only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, size, wide, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x, most = unpack(data, wide, dims, size).T, sorted(i for i in ids if i is not None)[:n]
                rows = sorted((i, x[k].tolist()) for k, i in enumerate(ids) if most and i is not None and i <= most[-1])[:n]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["id", "x"])

    first = blocks.select("ids", "n", "wide", "data").mapInArrow(run, "id long, x array<long>").orderBy("id", "x").limit(n).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), dims).T


def _coder(codebooks: np.ndarray, schema: pa.Schema):
    parts, width, _ = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, wide, data = (batch.column(c)[i].as_py() for c in range(3))
                x = unpack(data, wide, parts * width, n)
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p in range(parts):
                    codes[:, p], least = nearest(x[p * width : (p + 1) * width], codebooks[p])
                    error += least
                ends = pa.py_buffer(np.arange(0, 2 * parts * (n + 1), 2 * parts, dtype=np.int32) if parts else np.zeros(n + 1, np.int32))
                text = pa.StringArray.from_buffers(n, ends, pa.py_buffer(codes.tobytes().hex().encode()))
                cells = [batch.column(3).slice(i, 1).flatten(), text, pa.array(error), batch.column(4).slice(i, 1).flatten()]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)

    return run


def digest(codebooks: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, scratch: Scratch, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label, label_error; codebooks (parts, width, entries)) of every vector whose components are all there and finite.

    Codebooks start as the parts of the vectors with the smallest ids; a null id is never one of these, equal ids go by their components. Repeated
    rows are coded each. Vectors are of the length that most have, of the multiples of ``parts``; a vector of another length, or with a component
    that is too large for 64-bit distances (``vectors.largest``), takes no part and has code and error null. Without vectors to
    start from, nothing is coded and the codebooks are empty. ``label_error`` sums the errors of equal labels (null if beyond a long). At most
    256 entries. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    blocks = scratch.save(blocks_of(vectors, scale, id_col=id_col, vector_col=vector_col, label_col=label_col), "blocks")
    dims = main_length(blocks, parts)
    label_type = blocks.schema["labels"].dataType.elementType
    out = T.StructType.fromDDL("vec_id long, code string, error long").add("label", label_type)
    arrow = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64()), ("label", to_arrow_type(label_type))])
    usual = blocks.where(f"dims = {dims} AND data IS NOT NULL") if dims is not None else blocks.limit(0)
    start = _first_vectors(usual, dims or 0, entries)
    if not start.shape[1]:
        usual, others, codebooks = blocks.limit(0), blocks, np.zeros((parts, 0, 0), np.int64)
        coded = blocks.sparkSession.createDataFrame([], out)
    else:
        others = blocks.where(f"NOT (dims = {dims} AND data IS NOT NULL)")
        codebooks = train(usual, start.reshape(parts, dims // parts, -1), rounds)
        coded = usual.select("n", "wide", "data", "ids", "labels").mapInArrow(_coder(codebooks, arrow), out)
    rest = others.select(F.explode(F.arrays_zip("ids", "labels")).alias("r")).select(F.col("r.ids").alias("vec_id"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.col("r.labels").alias("label"))
    coded = scratch.save(coded.unionByName(rest), "coded")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(broadcast_if(sums, LABELS_BROADCAST), F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), codebooks


def decode(codes: list[str], codebooks: np.ndarray) -> np.ndarray:
    """(n, dims) integers that the codes stand for."""
    at = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), len(codebooks))
    return np.concatenate([codebooks[p][:, at[:, p]] for p in range(len(codebooks))]).T


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes(table(spark, sf_dir, "embeddings"), Scratch(spark, "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _sql() -> str:
    """Rounds one after the other; parts as rows, distances as sums over places."""
    near = "SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT x.vec_id, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {book} b USING (p, j) GROUP BY ALL) GROUP BY ALL"
    rounds = "".join(
        f""",
n{r} AS MATERIALIZED ({near.format(book=f"b{r}")}),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN
  (SELECT p, e, j, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM x JOIN n{r} USING (vec_id, p) GROUP BY ALL) m USING (p, e, j))"""
        for r in range(ROUNDS)
    )
    return f"""
WITH kept AS (SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
flat AS (SELECT vec_id, w, unnest(embedding) AS c, unnest(range(len(embedding))) AS k FROM kept),
x AS MATERIALIZED (SELECT vec_id, CAST(k // w AS INTEGER) AS p, CAST(k % w AS INTEGER) AS j, CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) AS v FROM flat),
b0 AS MATERIALIZED (SELECT p, CAST(rank - 1 AS INTEGER) AS e, j, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM kept QUALIFY rank <= {ENTRIES}) USING (vec_id)){rounds},
n AS MATERIALIZED ({near.format(book=f"b{ROUNDS}")}),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n GROUP BY vec_id)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c JOIN kept USING (vec_id)
"""


ORACLES = {"op11_vector_codes": _sql()}
