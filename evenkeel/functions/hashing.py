"""Reproducible randomness from hashed row keys.

A draw depends only on (seed, salts, key columns), so it is the same for any
partitioning, any retry of a lost task, and in any SQL engine that has ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed: int, *parts: Column | str) -> Column:
    """md5 hex digest of ``seed|part|part...``; strings name columns, use ``F.lit`` for salts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_as_column(p).cast("string") for p in parts]))


def hash_uniform(key: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of a hash key."""
    return F.conv(F.substring(_as_column(key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def hash_pick(key: Column | str, n: Column | str) -> Column:
    """Uniform integer in [0, n) from 52 bits, so groups beyond 2^32 rows are covered evenly."""
    unit = F.conv(F.substring(_as_column(key), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    return F.floor(unit * _as_column(n)).cast("long")
