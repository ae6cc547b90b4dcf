"""Vectors as whole numbers in blocks: columns of NumPy integers, a block for each Arrow batch.

A component x becomes ``floor(scale * x)``, worked out in doubles. A block holds the vectors of one length from one batch, dimension
by dimension, in the narrowest integer type that they fit; its ids and labels lie beside it. Blocks are written once to the
shared folder, so each later pass reads small integers and no pass reads the input again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches

#: Rows of a block at most; a batch of more is cut.
BLOCK_ROWS = 8192


def largest(dims: int) -> int:
    """Components beyond this could take the squared distance of two vectors out of a 64-bit integer."""
    return int((2.0**62 / max(1, dims)) ** 0.5 / 2)


def pack(columns: np.ndarray) -> tuple[int, bytes]:
    """(bytes of an integer, the columns one after the other)."""
    top = int(np.abs(columns).max(initial=0))
    wide = 2 if top < 1 << 15 else 4
    return wide, columns.astype(f"<i{wide}").tobytes()


def unpack(data: bytes, wide: int, dims: int, n: int) -> np.ndarray:
    """(dims, n) integers."""
    return np.frombuffer(data, f"<i{wide}").reshape(dims, n)


def whole_parts(vectors: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(dims, rows, columns) for vectors of each length; columns are None for rows with a component that is too large.

    Null vectors, and those with a null, infinite or not-a-number component, are in none.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
    parents = pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
    kept = lengths >= 0
    kept[parents[~np.isfinite(values)]] = False
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for dims in np.unique(lengths[kept]).tolist():
        rows = np.flatnonzero(kept & (lengths == dims))
        with np.errstate(over="ignore"):
            x = np.floor(values[starts[rows][:, None] + np.arange(dims)] * float(scale))
        near = (np.abs(x) <= largest(dims)).all(axis=1)
        for at in range(0, int(near.sum()), BLOCK_ROWS):
            some = rows[near][at : at + BLOCK_ROWS]
            yield dims, some, x[near][at : at + BLOCK_ROWS].astype(np.int64).T
        if not near.all():
            yield dims, rows[~near], None


def blocks_of(vectors: DataFrame, scale: int, *, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """dims, n, wide, data, ids, labels: one row a block. data is null for vectors with a component beyond ``largest``.

    Ids are whole numbers or what casts to them (else null). Extra columns are not read.
    """
    small_batches(vectors.sparkSession)
    label = vectors[label_col] if label_col else F.lit(None).cast("int")
    rows = vectors.select(vectors[id_col].try_cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"), label.alias("label"))
    label_type = rows.schema["label"].dataType
    out = T.StructType.fromDDL("dims int, n int, wide int, data binary, ids array<long>").add("labels", T.ArrayType(label_type))
    arrow = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("wide", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(to_arrow_type(label_type)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, rows, columns in whole_parts(batch.column(1), scale):
                wide, data = pack(columns) if columns is not None else (0, None)
                take = pa.array(rows)
                ends = pa.array([0, len(rows)], pa.int32())
                ids, labels = (pa.ListArray.from_arrays(ends, batch.column(c).take(take)) for c in (0, 2))
                cells = [pa.array([dims], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([wide], pa.int32()), pa.array([data], pa.binary()), ids, labels.cast(arrow.field("labels").type)]
                yield pa.RecordBatch.from_arrays(cells, schema=arrow)

    return rows.mapInArrow(run, out)


def main_length(blocks: DataFrame, multiple: int = 1) -> int | None:
    """The length that most vectors have (ties: the longer), of those that are positive multiples of a number."""
    counts = blocks.where(f"dims > 0 AND dims % {int(multiple)} = 0 AND data IS NOT NULL").groupBy("dims").agg(F.sum("n").alias("n"))
    first = counts.orderBy(F.desc("n"), F.desc("dims")).first()
    return first["dims"] if first else None
