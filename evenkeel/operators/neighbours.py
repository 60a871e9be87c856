"""Exact k-nearest-neighbour join within groups, without a pair table.

1. Equal feature vectors collapse to one vector that keeps its few smallest ids, so a
   block of copies costs one vector however large it is.
2. Large groups are cut into cells around pivot vectors; a cell beyond ``block_rows`` is
   cut further into hashed chunks on both sides. One task sees one chunk against one chunk.
3. Every vector searches its own cell; it then visits other cells in waves, the nearest bound
   first. After a wave its reach, the distance of its m-th best, is taken anew, and a vector whose
   next bound lies beyond it leaves. Results are exact in every case.

Tasks multiply blocks with numpy and emit k rows per vector, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.kernels import matrix, squared_distances
from evenkeel.operators.rank import sample_exact
from evenkeel.operators.small import bounded_rows, cut_lineage, local, local_frame, same

BLOCK_ROWS = 2048
#: Pivots of all groups together; they are shipped to every task.
MAX_PIVOTS = 16_384
#: Cells a vector has visited when its reach is taken anew; the last wave visits all that remain.
WAVES = (2, 8, 32, 128)


def knn(
    queries: DataFrame,
    targets: DataFrame | None,
    by: list[str],
    k: int,
    id_col: str = "row_id",
    features: str = "features",
    block_rows: int = BLOCK_ROWS,
    max_cells: int = 1024,
    visited: list | None = None,
) -> DataFrame:
    """``neighbours`` ARRAY<STRUCT<distance, id>>, nearest first, ties by id.

    With ``targets=None`` the rows search their own group and never find themselves
    (excluded by id, so exact copies do find each other). Rows without any neighbour
    get an empty array. ``visited`` receives the number of (vector, cell) visits of each wave.
    """
    to_self = targets is None
    m = k + 1 if to_self else k
    q_rows = _rows(queries, by, id_col, features)
    group = ["_g"]
    t_vecs = _vectors(q_rows if to_self else _rows(targets, by, id_col, features), group, m)
    q_vecs = (t_vecs.select("_g", "_h", "features", F.get("ids", F.lit(0)).alias("qid")) if to_self
              else q_rows.groupBy("_g", "_h", "features").agg(F.min("id").alias("qid")))
    found = _search(q_vecs, t_vecs, group, m, block_rows, max_cells, to_self, visited)
    best = (
        _best(found, group, m)
        .groupBy("_g", "qid")
        .agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("neighbours"))
    )
    # Row -> vector; the vector side has one row per key, and AQE splits a hot copy group.
    keyed = q_rows.join(q_vecs, ["_g", "_h", "features"]).select("_g", *by, "id", "qid")
    out = keyed.join(best, ["_g", "qid"], "left")
    near = F.coalesce("neighbours", F.array().cast(best.schema["neighbours"].dataType))
    if to_self:
        near = F.filter(near, lambda n: n["id"] != F.col("id"))
    return out.select(*by, F.col("id").alias(id_col), F.slice(near, 1, k).alias("neighbours"))


def _rows(df: DataFrame, by: list[str], id_col: str, features: str) -> DataFrame:
    """Group columns become one text key, never NULL: plain equality joins keep partitionings."""
    vec = F.col(features).cast("array<double>")
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    return df.select(*by, group.alias("_g"), F.col(id_col).cast("long").alias("id"), vec.alias("features"),
                     F.xxhash64(vec).alias("_h"))


def _vectors(rows: DataFrame, by: list[str], m: int) -> DataFrame:
    """Distinct vectors with their m smallest ids; the rank filter is applied before the shuffle."""
    keys = [*by, "_h", "features"]
    w = Window.partitionBy(*keys).orderBy("id")
    return (
        rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= m)
        .groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )


def _best(found: DataFrame, by: list[str], m: int) -> DataFrame:
    """The m nearest of each query, ties by id."""
    w = Window.partitionBy(*by, "qid").orderBy("distance", "id")
    return found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= m).drop("_rn")


def _search(q: DataFrame, t: DataFrame, by: list[str], m: int, block_rows: int, max_cells: int,
            to_self: bool, visited: list | None) -> DataFrame:
    sizes = _sizes(q, t, by, to_self)
    cells = max(1, min(max_cells, MAX_PIVOTS // max(len(sizes), 1)))
    if all(min(cells, -(-nt // block_rows)) <= 1 for _, _, nt in sizes):
        q, t = q.withColumn("cell", F.lit(0)), t.withColumn("cell", F.lit(0))
        return _blocks(q, t, by, m, block_rows, [((*g, 0), nq, nt) for g, nq, nt in sizes])

    schema = T.StructType([*[t.schema[c] for c in by], T.StructField("n", T.LongType()), T.StructField("quota", T.LongType())])
    quotas = local_frame(t.sparkSession, [(*g, nt, min(cells, -(-nt // block_rows))) for g, _, nt in sizes], schema)
    tid = t.withColumn("tid", F.get("ids", F.lit(0)))
    pivots = _Pivots(local(sample_exact(
        tid.select(*by, "tid", "features"), by, "tid", quotas, salt="pivot")), by)
    key = [*by, "cell"]
    t = cut_lineage(pivots.assign(t))
    q = cut_lineage(pivots.assign(q))
    found = cut_lineage(_best(_blocks(q, t, by, m, block_rows, _sizes(q, t, key, to_self)), by, m))
    pivots.radii = {
        (pivots.group_of(r), r["cell"]): (r["lo"], r["hi"])
        for r in bounded_rows(t.groupBy(*key).agg(F.min("_d").alias("lo"), F.max("_d").alias("hi")))}
    others = max(len(c) for c in pivots.centers.values()) - 1
    asking = q.withColumn("seen", F.array().cast("array<int>"))
    tried, near = 0, None
    for upto in [*(w for w in WAVES if 2 * w < others), others]:
        reach = found.groupBy(*by, "qid").agg(F.when(F.count(F.lit(1)) >= m, F.max("distance")).alias("reach"))
        visits = cut_lineage(pivots.visits(
            asking.alias("l").join(reach.alias("r"), same([*by, "qid"]), "left").select("l.*", "r.reach"), upto - tried))
        counts = _sizes(visits, t, key, False)
        if visited is not None:
            visited.append(sum(nq for _, nq, _ in counts))
        if not counts:
            return found
        near = _blocks(visits, t, by, m, block_rows, counts)
        if upto == others:
            break
        found = cut_lineage(_best(found.unionByName(near), by, m))
        # vectors that have more cells within reach go on; they keep the list of those visited
        went = visits.where("more").groupBy(*by, "qid").agg(F.collect_list("cell").alias("went"))
        asking = cut_lineage(asking.alias("l").join(went.alias("r"), same([*by, "qid"])).select(
            *[f"l.{c}" for c in q.columns], F.concat("l.seen", "r.went").alias("seen")))
        tried = upto
    return found.unionByName(near)


def _sizes(q: DataFrame, t: DataFrame, key: list[str], to_self: bool) -> list[tuple[tuple, int, int]]:
    """(group, queries, targets) of groups that have both; one small job."""
    n = F.count(F.lit(1))
    targets = t.groupBy(*key).agg(n.alias("nt"))
    if to_self:
        rows = targets.withColumn("nq", F.col("nt"))
    else:
        rows = q.groupBy(*key).agg(n.alias("nq")).alias("l").join(targets.alias("r"), same(key)).select("l.*", "r.nt")
    return [(tuple(r[c] for c in key), r["nq"], r["nt"]) for r in bounded_rows(rows)]


def _blocks(q: DataFrame, t: DataFrame, by: list[str], m: int, block_rows: int, counts: list) -> DataFrame:
    """Top m of every query against all targets of its cell, chunk against chunk."""
    key = [*by, "cell"]
    schema = T.StructType([*[q.schema[c] for c in key], T.StructField("qn", T.IntegerType()), T.StructField("tn", T.IntegerType())])
    sizes = F.broadcast(local_frame(
        q.sparkSession, [(*g, -(-nq // block_rows), -(-nt // block_rows)) for g, nq, nt in counts], schema))

    def spread(df, own, id_expr, n_own, n_other, other, cols):
        return (
            df.alias("l").join(sizes.alias("r"), same(key))
            .select(*[F.col(f"l.{c}").alias(c) for c in (*key, *cols)],
                    F.pmod(F.xxhash64(id_expr), F.col(f"r.{n_own}")).cast("int").alias(own),
                    F.explode(F.sequence(F.lit(0), F.col(f"r.{n_other}") - 1)).alias(other)))

    qs = spread(q, "_qc", F.col("l.qid"), "qn", "tn", "_tc", ("qid", "features"))
    ts = spread(t, "_tc", F.get(F.col("l.ids"), F.lit(0)), "tn", "qn", "_qc", ("ids", "features"))
    task = [*key, "_qc", "_tc"]
    schema = T.StructType(
        [f for f in q.schema.fields if f.name in by]
        + [T.StructField("qid", T.LongType()), T.StructField("distance", T.DoubleType()),
           T.StructField("id", T.LongType())])

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, d, ids = _top_m(left, right, m)
        cols = [pa.repeat(left.column(c)[0], len(qid)) if len(qid) else left.column(c).slice(0, 0)
                for c in by]
        return pa.table([*cols, pa.array(qid), pa.array(d), pa.array(ids)],
                        names=[*by, "qid", "distance", "id"])

    return qs.groupBy(*task).cogroup(ts.groupBy(*task)).applyInArrow(top, schema)


def _top_m(left: pa.Table, right: pa.Table, m: int):
    empty = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    if left.num_rows == 0 or right.num_rows == 0:
        return empty
    x, y = matrix(left.column("features")), matrix(right.column("features"))
    qid = left.column("qid").to_numpy()
    lists = right.column("ids").combine_chunks()
    ids = lists.flatten().to_numpy()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    starts = ends - lists.value_lengths().to_numpy()
    first = ids[starts]
    slack = 1e-9 * ((x * x).sum(1).max() + (y * y).sum(1).max())
    keep = min(m, len(y))
    out = []
    step = max(1, 2_000_000 // len(y))
    for s in range(0, len(x), step):
        xb = x[s:s + step]
        d = squared_distances(xb, y)
        limit = np.partition(d, keep - 1, axis=1)[:, keep - 1] + 2 * slack
        r, c = np.nonzero(d <= limit[:, None])
        exact = np.empty(len(r))
        for a in range(0, len(r), 200_000):  # direct differences: the product form cancels
            b = a + 200_000
            exact[a:b] = ((xb[r[a:b]] - y[c[a:b]]) ** 2).sum(1)
        r, c, exact = _first_per_row(r, c, exact, first[c], m)
        count = ends[c] - starts[c]  # expand each vector to its copies
        at = np.repeat(starts[c] - np.cumsum(count) + count, count) + np.arange(count.sum())
        r, exact, found = np.repeat(r, count), np.repeat(exact, count), ids[at]
        r, found, exact = _first_per_row(r, found, exact, found, m)
        out.append((qid[s + r], np.sqrt(exact), found))
    return tuple(np.concatenate(p) for p in zip(*out))


def _first_per_row(r, payload, d, tie, m):
    order = np.lexsort((tie, d, r))
    r, payload, d = r[order], payload[order], d[order]
    start = np.searchsorted(r, r, side="left")
    ok = np.arange(len(r)) - start < m
    return r[ok], payload[ok], d[ok]


class _Pivots:
    """Pivot vectors per group, and the bounds that rule out cells."""

    def __init__(self, frame: DataFrame, by: list[str]):
        self.by = by
        self.centers: dict[tuple, np.ndarray] = {}
        self.radii: dict[tuple, tuple[float, float]] = {}
        per: dict[tuple, list] = {}
        for r in frame.orderBy(*by, "tid").collect():
            per.setdefault(self.group_of(r), []).append(list(r["features"]))
        self.centers = {g: np.asarray(v, dtype=np.float64) for g, v in per.items()}

    def group_of(self, row) -> tuple:
        return tuple(row[c] for c in self.by)

    def _parts(self, batch: pa.RecordBatch):
        if not self.by:
            yield (), np.arange(batch.num_rows)
            return
        seen: dict[tuple, list[int]] = {}
        for i, g in enumerate(zip(*[batch.column(c).to_pylist() for c in self.by])):
            seen.setdefault(g, []).append(i)
        for g, rows in seen.items():
            yield g, np.asarray(rows)

    def assign(self, df: DataFrame) -> DataFrame:
        """Adds ``cell`` (nearest pivot) and ``_d`` (distance to it)."""
        parts, centers = self._parts, self.centers

        def run(batches):
            for b in batches:
                if b.num_rows == 0:
                    continue
                x = matrix(b.column("features"))
                cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                for g, rows in parts(b):
                    if g not in centers:
                        continue
                    d = squared_distances(x[rows], centers[g])
                    cell[rows] = d.argmin(1)
                    dist[rows] = np.sqrt(((x[rows] - centers[g][cell[rows]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "_d"])

        schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()),
                               T.StructField("_d", T.DoubleType())])
        return df.mapInArrow(run, schema)

    def visits(self, df: DataFrame, most: int) -> DataFrame:
        """Rows (vector, other cell): the ``most`` nearest cells not ``seen`` that may hold something within ``reach``.

        ``more`` tells that a vector has further ones.
        """
        parts, centers, by = self._parts, self.centers, self.by
        bounds = {
            g: (np.array([self.radii.get((g, j), (np.inf, -np.inf)) for j in range(len(c))]),
                np.sqrt(squared_distances(c, c)))
            for g, c in centers.items()}
        names = [*by, "cell", "qid", "features", "more"]

        def run(batches):
            for b in batches:
                if b.num_rows == 0:
                    continue
                x = matrix(b.column("features"))
                home = b.column("cell").to_numpy(zero_copy_only=False)
                reach = b.column("reach").to_numpy(zero_copy_only=False)
                reach = np.where(np.isnan(reach), np.inf, reach)
                seen = b.column("seen")
                lengths = seen.value_lengths().to_numpy()
                flat, ends = seen.flatten().to_numpy(), np.cumsum(lengths)
                for g, rows in parts(b):
                    if g not in centers:
                        continue
                    c, (radius, between) = centers[g], bounds[g]
                    d2 = squared_distances(x[rows], c)
                    d = np.sqrt(d2)
                    own = home[rows]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (d2 - d2[np.arange(len(rows)), own][:, None]) / (2 * between[own])
                    low = np.maximum(d - radius[:, 1], radius[:, 0] - d)
                    low = np.maximum(low, np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0))
                    slack = 1e-6 * (1.0 + d.max())
                    low[low > reach[rows][:, None] + slack] = np.inf
                    low[np.arange(len(rows)), own] = np.inf
                    low[:, ~np.isfinite(radius[:, 0])] = np.inf
                    for i, row in enumerate(rows):
                        low[i, flat[ends[row] - lengths[row]:ends[row]]] = np.inf
                    order = np.argsort(low, axis=1, kind="stable")[:, :most]
                    r, at = np.nonzero(np.isfinite(np.take_along_axis(low, order, 1)))
                    cell = order[r, at]
                    more = np.isfinite(low).sum(1) > most
                    take = pa.array(rows[r])
                    yield pa.RecordBatch.from_arrays(
                        [*[b.column(n).take(take) for n in by], pa.array(cell.astype(np.int32)),
                         b.column("qid").take(take), b.column("features").take(take), pa.array(more[r])], names=names)

        fields = {f.name: f for f in df.schema.fields} | {"more": T.StructField("more", T.BooleanType())}
        return df.mapInArrow(run, T.StructType([fields[n] for n in names]))
