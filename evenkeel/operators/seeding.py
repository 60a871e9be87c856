"""Seeds for k-means, drawn from all rows: a few distance-weighted passes, then a weighted summary.

A pass gives every row a key -ln(u) / d², u being uniform in its id's hash and d the distance to
the nearest candidate so far, and adds the rows with the smallest keys. That is a draw without
replacement with chances in proportion to d²: a far cluster is found however few rows it
has, since rows near a candidate hardly count any more. A pass returns at most ``draw`` rows whatever
the table's size, and each task sends that many at most.

A last pass counts and averages the rows nearest to each candidate. The averages with their
counts stand for the table: starts are drawn and settled on them, so starts cost no passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash_key, hash_uniform
from evenkeel.functions.kernels import matrix, nearest, squared_distances

#: Passes that draw candidates.
ROUNDS = 5


def candidates(rows: DataFrame, id_col: str, features: str, draw: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Distinct vectors of ``rows``: one by hash, then up to ``draw`` a round. Ties in the key go by the whole vector.

    The draw depends on ids and vectors only, not on partitions. Fewer vectors come back if the table has
    fewer; none from an empty one. Rows that share an id share their random number.
    """
    found = np.zeros((0, 0))
    for round_ in range(rounds + 1):
        held = found
        unit = hash_uniform(hash_key(seed, F.lit("seed"), F.lit(str(round_)), id_col))
        far = F.lit(1.0)
        if len(held):
            @F.arrow_udf("double")
            def distance(v: pa.Array) -> pa.Array:
                return pa.array(nearest(matrix(v), held)[1])

            far = distance(F.col(features))
        keyed = rows.select(F.col(features).alias("x"), far.alias("far"), unit.alias("unit")).where("far > 0")
        keyed = keyed.withColumn("key", F.try_divide(-F.log1p(-F.col("unit")), "far"))
        drawn = keyed.orderBy("key", F.xxhash64("x"), "x").limit(1 if not len(held) else draw).select("x").toArrow()
        if not drawn.num_rows:
            break
        new = np.unique(matrix(drawn.column("x")), axis=0)
        found = np.concatenate([held, new]) if len(held) else new
    return found


def weighted_start(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows of ``x``: each the best of a few drawn in proportion to weight times squared distance to those before."""
    trials = 2 + int(np.log(k))
    pick = lambda mass, n: np.minimum(np.searchsorted(np.cumsum(mass), rng.random(n) * mass.sum()), len(x) - 1)
    chosen = [int(pick(weight, 1)[0])]
    d = squared_distances(x, x[chosen]).ravel()
    while len(chosen) < k:
        mass = d * weight
        if mass.sum() <= 0:
            chosen.append(int(rng.integers(len(x))))
            continue
        some = pick(mass, trials)
        left = np.minimum(d[:, None], squared_distances(x, x[some]))
        best = int((weight @ left).argmin())
        chosen.append(int(some[best]))
        d = left[:, best]
    return x[chosen]


def settled(x: np.ndarray, weight: np.ndarray, centers: np.ndarray, max_iter: int, limit: float) -> np.ndarray:
    """Weighted assign-and-average steps over the summary, until the centres move less than ``limit``."""
    for _ in range(max_iter):
        near = nearest(x, centers)[0]
        n = np.bincount(near, weight, len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x * weight[:, None])
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centers)
        shift, centers = float(((new - centers) ** 2).sum()), new
        if shift <= limit:
            break
    return centers
