"""K-means for many (k, start) pairs in shared passes, silhouettes, cluster bookkeeping."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.kernels import list_column, matrix, nearest, squared_distances
from evenkeel.functions.numeric import euclidean
from evenkeel.operators import seeding
from evenkeel.operators.passes import hold, sum_rows
from evenkeel.operators.scale import moments
from evenkeel.operators.small import local, small

#: Most bytes of the vectors of one block in the exact silhouette; blocks of more rows than this are cut to feed all cores.
BLOCK_BYTES = 16_000_000
BLOCK_ROWS = 2048
#: Share of the squared norms below which a squared distance is taken from the differences.
_CLOSE = 1e-5
#: Least number of candidates that a seeding pass draws, and starts of each k that are finished on all rows.
DRAW, FINISHED = 40, 3


@dataclass
class Clustering:
    k: int
    centers: np.ndarray
    cost: float
    silhouette: float | None = None
    sizes: list[int] | None = None

    def assign(self, df: DataFrame, features: str = "features", name: str = "cluster") -> DataFrame:
        return assign_nearest(df, self.centers, features, name)


def assign_nearest(df: DataFrame, centers: np.ndarray, features: str = "features",
                   name: str = "cluster") -> DataFrame:
    """Index of the nearest centre (lowest index on ties). Map-only: no join, no shuffle."""
    centers = np.asarray(centers, dtype=np.float64)
    if len(centers) <= 1:
        return df.withColumn(name, F.lit(0))

    @F.arrow_udf("int")
    def index(v: pa.Array) -> pa.Array:
        return pa.array(nearest(matrix(v), centers)[0].astype(np.int32))

    return df.withColumn(name, index(F.col(features).cast("array<double>")))


def mean_by(df: DataFrame, by: list[str], features: str = "features", name: str = "center") -> DataFrame:
    """Mean vector and row count per group."""
    stats = df.select(*by, array_to_vector(F.col(features).cast("array<double>")).alias("_v")).groupBy(
        *by).agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("_s"))
    return stats.select(*by, F.col("_s.count").alias("n"), vector_to_array("_s.mean").alias(name))


def lloyd_step(df: DataFrame, centers: np.ndarray, features: str = "features") -> DataFrame:
    """One assign-and-average step: cluster, n, center."""
    return mean_by(assign_nearest(df, centers, features), ["cluster"], features)


def _sums(x: np.ndarray, models: list[np.ndarray], width: int) -> np.ndarray:
    """Per centre of all models, one below the other: row count, inertia, vector sum."""
    out = []
    for centers in models:
        near, best = nearest(x, centers)
        hot = np.zeros((len(x), len(centers)))
        hot[np.arange(len(x)), near] = 1.0
        out.append(np.column_stack([hot.sum(0), hot.T @ best, hot.T @ x]))
    return np.concatenate(out) if out else np.zeros((0, width + 2))


def _move(sums: np.ndarray, models: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """New centres and cost of every model; a centre without rows stays where it is."""
    out, at = [], 0
    for centers in models:
        part = sums[at:at + len(centers)]
        at += len(centers)
        n = part[:, :1]
        out.append((np.where(n > 0, part[:, 2:] / np.maximum(n, 1), centers), float(part[:, 1].sum())))
    return out


def fit_kmeans(
    df: DataFrame, ks: list[int], id_col: str = "row_id", features: str = "features",
    n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 42,
) -> list[Clustering]:
    """Best of ``n_init`` starts for every k in ``ks``; all models share each pass over the data.

    Seeds come from passes over all rows (``seeding``), at every size of the table. All starts are drawn
    and settled on the weighted summary; the ``FINISHED`` best of each k there are finished on all rows,
    whose cost decides. A pass returns one sum per (partition, model, cluster). Stops when all centres moved less than ``tol`` times the mean
    feature variance.
    """
    rows, _, partitions = hold(df.select(id_col, F.col(features).cast("array<double>").alias(features)))
    try:
        row = moments(rows, [], features).first()
        limit = tol * float(np.mean(row["var"]))
        width = len(row["mean"])
        points = seeding.candidates(rows, id_col, features, max(DRAW, 2 * max(ks)), seed)
        sums = _all_sums(rows, [points], features, width, partitions)
        sums = sums[sums[:, 0] > 0]
        weight, points = sums[:, 0], sums[:, 2:] / sums[:, :1]
        models = {}
        for k in ks:
            tried = []
            for s in range(n_init if k > 1 else 1):
                start = seeding.weighted_start(points, weight, k, np.random.default_rng([seed, k, s]))
                centers = seeding.settled(points, weight, start, max_iter, limit)
                tried.append((float(f"{weight @ nearest(points, centers)[1]:.9g}"), s, centers))
            for _, s, centers in sorted(tried, key=lambda t: t[:2])[:FINISHED]:
                models[k, s] = centers
        cost = _passes(rows, models, features, width, partitions, max_iter, limit)
        out = []
        for k in ks:
            # starts that end alike differ in the last digits only: the first of them counts
            best = min((m for m in models if m[0] == k), key=lambda m: (float(f"{cost[m]:.9g}"), m[1]))
            out.append(Clustering(k, models[best], cost[best]))
        return out
    finally:
        rows.unpersist()


def settle(df: DataFrame, starts: list[np.ndarray], features: str = "features", max_iter: int = 300,
           tol: float = 1e-4) -> list[Clustering]:
    """Clusterings from given centres: shared assign-and-average passes. ``cost`` is that of the last assignment."""
    rows, _, partitions = hold(df.select(F.col(features).cast("array<double>").alias(features)))
    try:
        row = moments(rows, [], features).first()
        models = {i: np.asarray(c, dtype=np.float64) for i, c in enumerate(starts)}
        cost = _passes(rows, models, features, len(row["mean"]), partitions, max_iter, tol * float(np.mean(row["var"])))
        return [Clustering(len(models[i]), models[i], cost[i]) for i in models]
    finally:
        rows.unpersist()


def _passes(rows: DataFrame, models: dict, features: str, width: int, partitions: int, max_iter: int, limit: float) -> dict:
    """Moves the centres of all ``models``, in place, until each has settled; their costs."""
    cost, moving = {m: float("inf") for m in models}, set(models)
    for _ in range(max_iter):
        if not moving:
            break
        names = sorted(moving)
        sums = _all_sums(rows, [models[m] for m in names], features, width, partitions)
        for m, (new, inertia) in zip(names, _move(sums, [models[m] for m in names])):
            if float(((new - models[m]) ** 2).sum()) <= limit:
                moving.discard(m)
            models[m], cost[m] = new, inertia
    return cost


def _all_sums(rows: DataFrame, models: list[np.ndarray], features: str, width: int, partitions: int) -> np.ndarray:
    count = sum(len(m) for m in models)

    def run(batches):
        acc = np.zeros((count, width + 2))
        for b in batches:
            if b.num_rows:
                acc += _sums(matrix(b.column(0)), models, width)
        hit = np.nonzero(acc[:, 0])[0]
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(hit.astype(np.int32)), list_column(acc[hit])], names=["at", "values"])

    parts = rows.select(features).mapInArrow(run, "at int, values array<double>")
    return sum_rows(parts, partitions, count, width + 2)


def silhouettes(df: DataFrame, models: list[Clustering], features: str = "features") -> list[float]:
    """Mean squared-distance silhouette of several clusterings, in two linear passes.

    The mean squared distance of x to a cluster needs only its size, its sum and its sum
    of squared norms, so no pair of rows is ever formed.
    """
    rows = df.select(F.col(features).cast("array<double>").alias(features))
    middle = np.mean([m.centers.mean(0) for m in models], axis=0)  # keeps the digits of features far from 0
    centers = [m.centers - middle for m in models]

    width = len(centers[0][0])
    count = sum(len(c) for c in centers)
    partitions = rows.rdd.getNumPartitions()

    def totals(batches):
        acc = np.zeros((count, width + 2))
        for b in batches:
            if b.num_rows == 0:
                continue
            x = matrix(b.column(0)) - middle
            norm, at = (x * x).sum(1), 0
            for c in centers:
                near = nearest(x, c)[0]
                hot = np.zeros((len(x), len(c)))
                hot[np.arange(len(x)), near] = 1.0
                acc[at:at + len(c)] += np.column_stack([hot.sum(0), hot.T @ norm, hot.T @ x])
                at += len(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(count, dtype=np.int32)), list_column(acc)], names=["at", "values"])

    sums = sum_rows(rows.mapInArrow(totals, "at int, values array<double>"), partitions, count, width + 2)
    table, at = [], 0
    for m, c in zip(models, centers):
        part = sums[at:at + len(c)]
        at += len(c)
        n = part[:, 0]
        m.sizes = n.astype(int).tolist()
        table.append((n, part[:, 2:] / np.maximum(n, 1)[:, None], part[:, 1] / np.maximum(n, 1)))

    def scores(batches):
        total, seen = np.zeros(len(centers)), 0
        for b in batches:
            if b.num_rows == 0:
                continue
            x = matrix(b.column(0)) - middle
            seen += len(x)
            for i, c in enumerate(centers):
                n, mean, norm = table[i]
                near = nearest(x, c)[0]
                d = np.maximum((x * x).sum(1)[:, None] + norm[None, :] - 2 * (x @ mean.T), 0.0)
                own = np.arange(len(x)), near
                size = n[near]
                a = d[own] * size / np.maximum(size - 1, 1)
                d[own] = np.inf
                d[:, n == 0] = np.inf
                other = d.min(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where(np.isfinite(other), (other - a) / np.maximum(a, other), 0.0)
                s[(size <= 1) | ~np.isfinite(s)] = 0.0
                total[i] += s.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), list_column(np.append(total, seen)[None, :])], names=["at", "values"])

    out = sum_rows(rows.mapInArrow(scores, "at int, values array<double>"), partitions, 1, len(centers) + 1)[0]
    return [float(v) / out[-1] for v in out[:-1]]


def _one_hot(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, inverse = np.unique(c, return_inverse=True)
    hot = np.zeros((len(c), len(kinds)))
    hot[np.arange(len(c)), inverse] = 1.0
    return kinds, hot


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y by one matrix product; close pairs, where it loses digits, by their differences."""
    fine = y[np.isfinite(y).all(1)]
    middle = fine.mean(0) if len(fine) else 0.0
    x, y = x - middle, y - middle
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    d = x @ y.T
    d *= -2.0
    d += nx[:, None]
    d += ny[None, :]
    i, j = np.nonzero(~(d > _CLOSE * (nx[:, None] + ny[None, :])))
    for at in range(0, len(i), 16_384):
        diff = x[i[at:at + 16_384]] - y[j[at:at + 16_384]]
        d[i[at:at + 16_384], j[at:at + 16_384]] = (diff * diff).sum(1)
    return np.sqrt(d, out=d)


def silhouette_exact(df: DataFrame, cluster: str = "cluster", id_col: str = "row_id",
                     features: str = "features", block_rows: int | None = None) -> DataFrame:
    """Per-row Euclidean silhouette. Quadratic work by nature, so for moderate tables only.

    Each two blocks of rows meet once, for both sides; a task returns one distance sum per
    (row, cluster), never a pair of rows. ``block_rows``: rows of a block; by default as many as
    BLOCK_BYTES hold, fewer if there were fewer tasks than cores.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(cluster).cast("int").alias("c"),
                     F.col(features).cast("array<double>").alias("features"))
    sizes = local(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")))
    total, width = sizes.agg(F.sum("n"), F.max("width")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if block_rows is None:
        most = max(1, BLOCK_BYTES // (8 * max(width or 1, 1)))
        blocks = max(-(-(total or 0) // most), min(-(-(total or 0) // BLOCK_ROWS), int((8 * cores) ** 0.5) + 1), 1)
    else:
        blocks = max(1, -(-(total or 0) // block_rows))
    home = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    sent = rows.withColumn("home", home).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k"))
    sent = sent.select("id", "c", "features", "home", F.least("home", "k").alias("a"), F.greatest("home", "k").alias("b"))

    def sums(part: pa.Table) -> pa.Table:
        names = ["id", "other", "total"]
        a, b = part.column("a")[0].as_py(), part.column("b")[0].as_py()
        at = part.column("home").to_numpy()
        sides = [part.filter(pa.array(at == h)) for h in dict.fromkeys((a, b))]
        if any(side.num_rows == 0 for side in sides):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.float64())], names=names)
        x, y = matrix(sides[0].column("features")), matrix(sides[-1].column("features"))
        kinds, hot = zip(*(_one_hot(side.column("c").to_numpy()) for side in sides))
        over = [np.zeros((len(x), len(kinds[-1])))]
        if a != b:
            over.append(np.zeros((len(y), len(kinds[0]))))
        step = max(1, 4_000_000 // len(y))
        for s in range(0, len(x), step):
            d = _distances(x[s:s + step], y)
            over[0][s:s + step] = d @ hot[-1]
            if a != b:
                over[1] += d.T @ hot[0][s:s + step]
        ids = [np.repeat(side.column("id").to_numpy(), o.shape[1]) for side, o in zip(sides, over)]
        others = [np.tile(k.astype(np.int32), len(o)) for k, o in zip(kinds[::-1], over)]
        return pa.table([np.concatenate(ids), np.concatenate(others), np.concatenate([o.ravel() for o in over])], names=names)

    tasks = min(blocks * (blocks + 1) // 2, 16 * cores)
    parts = sent.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(sums, "id long, other int, total double")
    per = parts.groupBy("id", "other").agg(F.sum("total").alias("total"))
    own = rows.select("id", "c").join(small(sizes), "c").select("id", "c", F.col("n").alias("own_n"))
    joined = per.join(own, "id").join(
        F.broadcast(sizes.select(F.col("c").alias("other"), F.col("n").alias("other_n"))), "other")
    inner = F.when((F.col("other") == F.col("c")) & (F.col("own_n") > 1), F.col("total") / (F.col("own_n") - 1))
    outer = F.when(F.col("other") != F.col("c"), F.col("total") / F.col("other_n"))
    ab = joined.groupBy("id", "c").agg(F.max(inner).alias("a"), F.min(outer).alias("b"))
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return ab.select(F.col("id").alias(id_col), F.col("c").alias(cluster),
                     F.coalesce(score, F.lit(0.0)).alias("silhouette"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size and share of the class per cluster."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy()))


def choose_k(
    df: DataFrame, k_min: int = 2, k_max: int = 10, min_cluster_rows: int = 0,
    id_col: str = "row_id", features: str = "features", n_init: int = 10, max_iter: int = 300,
    tol: float = 1e-4, seed: int = 42,
) -> tuple[Clustering, list[dict]]:
    """Clustering with the best silhouette, smallest k on ties, and the table of scores.

    A k with a cluster below ``min_cluster_rows`` scores -1; if every k does, or no k fits
    the row count, everything is one cluster.
    """
    n = df.count()
    k_max = min(k_max, n - 1)
    one = Clustering(1, np.zeros((1, 1)), 0.0)
    if k_max < k_min:
        return one, []
    models = fit_kmeans(df, list(range(k_min, k_max + 1)), id_col, features, n_init, max_iter, tol, seed)
    scores = silhouettes(df, models, features)
    table = []
    for m, s in zip(models, scores):
        low = min(m.sizes)
        m.silhouette = s if low >= min_cluster_rows else -1.0
        table.append({"k": m.k, "silhouette": m.silhouette, "cost": m.cost, "smallest": low})
    best = max(models, key=lambda m: (m.silhouette, -m.k))
    if min_cluster_rows > 0 and best.silhouette == -1.0:
        return one, table
    return best, table


def merge_small_clusters(sizes: DataFrame, centers: DataFrame, min_rows: int) -> DataFrame:
    """cluster -> merged: each small cluster goes to the large one with the nearest centre.

    ``sizes``: cluster, n. ``centers``: cluster, center. Both have one row per cluster.
    Large clusters, and all of them if none is large, map to themselves.
    """
    info = local(sizes.join(centers, "cluster").select("cluster", "n", "center"))
    is_large = F.col("n") >= min_rows
    with_large = info.withColumn("large", F.collect_list(F.when(
        is_large, F.struct("cluster", "center"))).over(Window.partitionBy()))
    nearest = F.array_min(F.transform("large", lambda t: F.struct(
        euclidean(F.col("center"), t["center"]).alias("d"), t["cluster"].alias("c"))))["c"]
    small_ = (F.col("n") < min_rows) & (F.size("large") > 0)
    return with_large.select("cluster", F.when(small_, nearest).otherwise(F.col("cluster")).alias("merged"))


def relabel(df: DataFrame, mapping: DataFrame, cluster: str = "cluster") -> DataFrame:
    out = df.alias("l").join(small(mapping).alias("r"), F.col(f"l.{cluster}") == F.col("r.cluster"))
    return out.select(*[F.col("r.merged").alias(c) if c == cluster else F.col(f"l.{c}") for c in df.columns])
