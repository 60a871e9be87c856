"""Shared passes: sums of model-sized arrays over all rows."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.kernels import matrix

#: Partial results (partitions x rows x width) up to this many numbers are added on the driver.
DRIVER_NUMBERS = 4_000_000


def hold(df: DataFrame, rows_per_core: int = 32) -> tuple[DataFrame, int, int]:
    """(kept rows, row count, partitions) for a fit that reads them many times.

    Rows in fewer partitions than there are cores are spread once; many partitions stay
    as they are. Lost partitions are recomputed from the source. Unpersist when done.
    """
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    n, parts = rows.count(), rows.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if parts < cores and n >= cores * rows_per_core:
        wide = rows.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
        wide.count()
        rows.unpersist()
        return wide, n, cores
    return rows, n, parts


def sum_rows(parts: DataFrame, partitions: int, rows: int, width: int) -> np.ndarray:
    """Adds (at INT, values ARRAY<DOUBLE>) over all partitions into a rows x width array.

    Few partial results are added on the driver; many are added in a shuffle first, so
    that only rows x width numbers ever arrive.
    """
    if partitions * rows * width > DRIVER_NUMBERS:
        parts = parts.groupBy("at").agg(
            vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("values"))
    table = parts.toArrow()
    out = np.zeros((rows, width))
    if table.num_rows:
        np.add.at(out, table.column("at").to_numpy(), matrix(table.column("values")))
    return out
