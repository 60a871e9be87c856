"""Bounded frames: the only data that may reach the driver or be broadcast."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Most rows a class-, cluster- or configuration-level frame may have to be broadcast.
SMALL_ROWS = 100_000


def try_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list[Row] | None:
    """Rows of ``df`` on the driver, or None if there are more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def bounded_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list[Row]:
    """``try_rows`` for frames that are small by definition; raises when the bound does not hold."""
    rows = try_rows(df, limit)
    if rows is None:
        raise ValueError(f"expected at most {limit} class-level rows, got more: {df.columns}")
    return rows


def local_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """Local relation from driver rows (tuples in schema order); scanning it needs no job."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], schema)
    cols = {}
    for i, f in enumerate(schema.fields):
        cols[f.name] = pa.array([_plain(r[i]) for r in rows], type=to_arrow_type(f.dataType))
    return spark.createDataFrame(pa.table(cols), schema=schema)


def _plain(v):
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def local(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` as a local relation of checked size: joins with it never re-run the job behind it."""
    return local_frame(df.sparkSession, bounded_rows(df, limit), df.schema)


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``local`` marked for broadcast: the hint is only set after the size was checked."""
    return F.broadcast(local(df, limit))


def same(by: list[str], left: str = "l", right: str = "r"):
    """Null-safe equality over key columns of two aliased frames."""
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="evenkeel-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
