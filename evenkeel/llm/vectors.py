"""Vectors as whole numbers: packed rows, first copies, blocks of queries, exact inner products.

A component becomes floor(scale * x) and is held to 32 bits, and to what keeps the inner product
of two vectors of that width within 2^61: ``floor(sqrt(2^61 / width))``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the vectors of a block of queries; blocks are cut for half of it, by hash.
BLOCK_BYTES = 16_000_000
#: Largest whole number up to which doubles are exact.
_EXACT = 2**53


def most(width: int) -> int:
    """Largest component held, so that no inner product passes 2^61."""
    return min(2**31 - 1, math.isqrt(2**61 // max(width, 1)))


def whole_vectors(table: DataFrame, scale: int, id_col: str = "vec_id", vec: str = "embedding", label: Column | None = None) -> DataFrame:
    """(id, label, width, data, square) of the rows of ``table`` that take part.

    ``data`` holds 32-bit whole numbers, ``square`` is their inner product with themselves. Rows with a null vector,
    a null or non-finite component or, where ``label`` is given, a null label are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            widths = column.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(width)).astype(np.float64)
                fine = np.isfinite(x).all(axis=1)  # a null component reads as NaN
                at, x = at[fine], x[fine]
                if not len(at):
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(scale * x), -most(int(width)), most(int(width)))
                data = np.ascontiguousarray(x.astype("<i4"))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(rows), batch.column("label").take(rows), pa.array(np.full(len(at), width, np.int32)),
                    pa.array([r.tobytes() for r in data], pa.binary()), pa.array((data.astype(np.int64) ** 2).sum(axis=1))],
                    ["id", "label", "width", "data", "square"])

    rows = table.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"),
                        F.col(vec).cast("array<double>").alias("vec")).where("vec is not null and label is not null")
    return rows.mapInArrow(run, "id long, label long, width int, data binary, square long")


def first_copies(rows: DataFrame, keep: int) -> DataFrame:
    """Of the rows that share label and vector those with the ``keep`` smallest ids, null last.

    The rank limit works before the shuffle too, so a vector that most rows share is one small group.
    """
    order = Window.partitionBy("label", "width", "data").orderBy(F.col("id").asc_nulls_last())
    return rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= keep).drop("copy")


def blocks_of(queries: DataFrame) -> tuple[DataFrame, int]:
    """``queries`` with ``block``, and the number of blocks: vectors of a block fit ``BLOCK_BYTES``."""
    size = queries.agg(F.sum(F.octet_length("data") + 64)).first()[0] or 0
    count = -(-int(size) // (BLOCK_BYTES // 2)) if size > BLOCK_BYTES // 2 else 1
    return queries.withColumn("block", F.pmod(F.xxhash64("width", "data", "label"), F.lit(count)).cast("int")), count


def block_rows(queries: DataFrame, block: int) -> pa.Table:
    """One block on the driver, in the order of its numbers ``q``; its bytes are checked."""
    found = queries.where(F.col("block") == block).drop("block").toArrow().sort_by("q")
    if found.nbytes > 2 * BLOCK_BYTES:
        raise ValueError(f"a block of queries has {found.nbytes} bytes")
    return found


def matrix(column, width: int) -> np.ndarray:
    """Rows of packed numbers, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = b"".join(column.to_pylist())
    return np.frombuffer(bytearray(parts), "<i4").reshape(len(column), width).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two matrices of whole numbers, exact: by doubles while these hold them, else by 64-bit integers."""
    top = lambda x: float(np.abs(x).max()) if x.size else 0.0
    if a.shape[1] * top(a) * top(b) < _EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
