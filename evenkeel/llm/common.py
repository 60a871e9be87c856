"""Shared helpers: stored intermediate tables, bounded batch slices, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.small import local_frame, try_rows

#: Most text that a task turns into Python objects at once.
SLICE_BYTES = 1_500_000
#: Bytes of a batch that goes to a Python task where whole texts do; Spark's own bound is 64 MB, which both sides hold twice.
BATCH_BYTES = 4_000_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A node of more edges is a hub: its smallest neighbour goes to its edges, which stay where they are.
HUB = 1000


class _Open(threading.local):
    """Per thread: lists of the tables that open calls of ``settled`` have stored; empty where functions travel to."""

    def __init__(self):
        self.calls: list[list[str]] = []

    def __reduce__(self):
        return _Open, ()


_OPEN = _Open()


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share; a temporary one only in local sessions that name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="evenkeel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: no lineage, no second computation."""
    path = new_path(df.sparkSession, "stored")
    if _OPEN.calls:
        _OPEN.calls[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``stored(build())``; the tables that ``build`` stored on its way are deleted, so nothing else may read them."""
    _OPEN.calls.append([])
    try:
        found = build()
    finally:
        made = _OPEN.calls.pop()
    out = stored(found)
    for path in made:
        _delete(spark, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            _delete(table.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_small_batches(rows: DataFrame) -> DataFrame:
    """``rows``; the session's Arrow batches are BATCH_BYTES from now on, unless it sets a bound of its own."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return rows


def fold(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % buckets


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``text`` holds about ``limit`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes per row; null is empty."""
    return pc.fill_null(batch.column(name).cast(pa.binary()), b"").to_pylist()


def _star(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Edges with ``low``, the smallest neighbour of ``node``; at most one of HUB edges has a hub, so hubs are few."""
    lows = edges.groupBy(node).agg(F.min(other).alias("low"), F.count(F.lit(1)).alias("n"))
    hubs, others = lows.where(F.col("n") > HUB), lows.where(F.col("n") <= HUB)
    rest = edges.join(F.broadcast(hubs.select(node)), node, "left_anti").join(others.select(node, "low"), node)
    return rest.union(edges.join(F.broadcast(hubs.select(node, "low")), node))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that ``edges`` (a, b: long) touch; root: the smallest node reachable.

    Alternates large and small stars; each round is a stored table, so no lineage grows and no
    group is gathered in one task. Rounds grow with the logarithm of the longest chain.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "a", "b").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        large = stored(large)
        linked = _star(large, "a", "b")
        small = linked.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = stored(small.union(linked.select("a", F.col("low").alias("b"))).distinct())
        discard(edges, large)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def chosen(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` joined with ``ids``, one row per ``key``: broadcast while few, else by a shuffle."""
    found = try_rows(ids)
    few = stored(ids) if found is None else F.broadcast(local_frame(rows.sparkSession, found, ids.schema))
    return rows.join(few, key)
