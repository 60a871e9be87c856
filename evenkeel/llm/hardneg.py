"""Hard negatives by coordinate pruning: length buckets, sorted coordinate lists, feasible ranges, exact check.

Rows are sorted by length into buckets; a bucket holds, for each coordinate, its rows in the order
of that coordinate of their directions. An anchor that needs a score of at least t skips the
buckets whose longest row is too short. In the others it takes its focus coordinates, the largest
of its direction: a row whose cosine with the anchor is at least t over both lengths lies inside
a cap, whose extent along a coordinate is a range of the sorted list. Rows in the ranges of all
focus coordinates are checked exactly; where a range holds most of a bucket it excludes nothing,
and the bucket is checked by one matrix product.

Buckets come in waves, the longest rows first. Each wave raises t to the score of the last of the
best found so far, so later waves exclude more. What is dropped cannot be among the best.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import stored
from evenkeel.llm.vectors import block_rows, blocks_of, first_copies, matrix, products, whole_vectors

#: Rows of a bucket, and the shortest row's share of the longest one's length.
BUCKET_ROWS, SHORTEST = 2048, 0.9
#: Coordinates whose ranges are intersected.
FOCUS = 4
#: Share of the buckets behind the first and the second wave.
WAVES = (1 / 16, 1 / 4)
#: Anchors of one matrix product.
_ANCHORS = 512
_LEAST, _MOST = -(2**62), 2**62
_NONE = 2**63 - 1


def buckets(rows: DataFrame, size: int = BUCKET_ROWS) -> DataFrame:
    """(key, width, longest, ids, labels, data, sorted): rows (id, label, width, data, square) by falling length.

    ``sorted`` holds for each coordinate the places of the rows in the order of their directions.
    ``key`` falls with the length. A null id is the largest one.
    """

    def run(batches):
        held = None

        def bucket(t: pa.Table) -> pa.RecordBatch:
            width, norm = int(t["width"][0].as_py()), np.sqrt(t["square"].to_numpy())
            x = matrix(t["data"], width) / np.maximum(norm, 1e-300)[:, None]
            order = np.argsort(x, axis=0, kind="stable").T.astype("<u2")
            ids = t["id"].combine_chunks().fill_null(_NONE)
            return pa.RecordBatch.from_arrays([
                pa.array([float(norm[0])]), pa.array([width], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                pa.array([t["label"].to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(t["data"].to_pylist())], pa.binary()),
                pa.array([np.ascontiguousarray(order).tobytes()], pa.binary())],
                ["longest", "width", "ids", "labels", "data", "sorted"])

        def full(t: pa.Table, last: bool):
            norm, width = np.sqrt(t["square"].to_numpy()), t["width"].to_numpy()
            start = 0
            while start < len(norm):
                short = np.flatnonzero((norm[start:] < SHORTEST * norm[start]) | (width[start:] != width[start]))
                stop = min(start + size, start + int(short[0]) if len(short) else len(norm))
                if stop == len(norm) and stop - start < size and not last:
                    break
                yield bucket(t.slice(start, stop - start))
                start = stop
            return t.slice(start)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = yield from full(t if held is None else pa.concat_tables([held, t]), False)
        if held is not None and held.num_rows:
            yield from full(held, True)

    order = [F.col("width"), F.desc("square"), F.xxhash64("data", "id")]
    dealt = rows.select("id", "label", "width", "data", "square").repartitionByRange(*order).sortWithinPartitions(*order)
    packed = dealt.mapInArrow(run, "longest double, width int, ids array<long>, labels array<long>, data binary, sorted binary")
    # among equal lengths the order of work is that of a hash
    key = F.col("longest") * (1 - F.pmod(F.xxhash64("data"), F.lit(1000)) / 1e9)
    return stored(packed.withColumn("key", key))


def _ranges(q: np.ndarray, cosine: float, focus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of the focus coordinates of a direction whose cosine with ``q`` is ``cosine`` or more."""
    wide = np.arccos(np.clip(cosine, -1.0, 1.0))
    own = np.arccos(np.clip(q[focus], -1.0, 1.0))
    return np.cos(np.minimum(own + wide, np.pi)) - 1e-9, np.cos(np.maximum(own - wide, 0.0)) + 1e-9


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k``: larger score first, smaller id on ties."""
    return np.lexsort((ids, -scores))[:k]


def search(packed: DataFrame, anchors: pa.Table, low: np.ndarray, high: np.ndarray, same: bool, k: int,
           focus: int = FOCUS) -> DataFrame:
    """(q, win, id, score): for each anchor and window the best ``k`` rows of each task with low <= score <= high.

    ``anchors`` has q, label, width, data; ``low`` and ``high`` are (anchors, windows), a window with
    low > high being shut. Rows have the anchor's own label if ``same``, else another one.
    """
    shared = packed.sparkSession.sparkContext.broadcast((anchors.select(["q", "label", "width", "data"]), low, high))

    def run(batches):
        table, low, high = shared.value
        widths = table["width"].to_numpy()
        groups = {}
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            x = matrix(table["data"].take(pa.array(at)), int(width))
            norm = np.sqrt((x * x).sum(axis=1))
            unit = x / np.maximum(norm, 1e-300)[:, None]
            groups[int(width)] = at, x, norm, unit, np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :focus]
        numbers, labels = table["q"].to_numpy(), table["label"].to_numpy()
        out: list[tuple] = []

        def take(a: int, ids, scores):
            """Rows of one bucket that may count for anchor ``a``."""
            for w in range(low.shape[1]):
                fit = (scores >= low[a, w]) & (scores <= high[a, w])
                if fit.any():
                    i, s = ids[fit], scores[fit]
                    best = _best(s, i, k)
                    out.append((np.full(len(best), numbers[a]), np.full(len(best), w, np.int32), i[best], s[best]))

        def dense(rows, x, own, ids, mine):
            """A bucket against all of ``rows`` (places of anchors)."""
            for j in range(0, len(rows), _ANCHORS):
                some = rows[j : j + _ANCHORS]
                s = products(own[j : j + _ANCHORS], x)
                right = (labels[some][:, None] == mine[None, :]) == same
                for w in range(low.shape[1]):
                    fit = right & (s >= low[some, w][:, None]) & (s <= high[some, w][:, None])
                    many = np.flatnonzero(fit.sum(axis=1) > 4 * k)
                    if len(many):  # only the best can stay: raise the bound of this bucket
                        part = np.where(fit[many], s[many], _LEAST)
                        fit[many] &= s[many] >= np.partition(part, part.shape[1] - k, axis=1)[:, -k][:, None]
                    i, r = np.nonzero(fit)
                    if len(i):
                        score, at = s[i, r], ids[r]
                        order = np.lexsort((at, -score, i))
                        i, score, at = i[order], score[order], at[order]
                        first = np.searchsorted(i, i)
                        keep = np.arange(len(i)) - first < k
                        out.append((numbers[some][i[keep]], np.full(int(keep.sum()), w, np.int32), at[keep], score[keep]))

        def rows():
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "win", "id", "score"])

        for batch in batches:
            for b in range(batch.num_rows):
                row = {c: batch.column(c)[b] for c in ("longest", "width", "ids", "labels", "data", "sorted")}
                width, longest = row["width"].as_py(), row["longest"].as_py()
                if width not in groups:
                    continue
                at, own, norm, unit, chosen = groups[width]
                ids, mine = row["ids"].values.to_numpy(), row["labels"].values.to_numpy()
                x = np.frombuffer(bytearray(row["data"].as_py()), "<i4").reshape(len(ids), width).astype(np.float64)
                lists = np.frombuffer(bytearray(row["sorted"].as_py()), "<u2").reshape(width, len(ids))
                length = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)
                open_ = low[at] <= high[at]
                need = np.where(open_, low[at], _MOST).min(axis=1)
                able = open_.any(axis=1) & (need <= norm * longest * (1 + 1e-9))
                values, whole = {}, []
                for a in np.flatnonzero(able).tolist():
                    if need[a] <= 0:
                        whole.append(a)
                        continue
                    least, most = _ranges(unit[a], need[a] / (norm[a] * longest) * (1 - 1e-9), chosen[a])
                    spans = []
                    for c, lo, hi in zip(chosen[a].tolist(), least, most):
                        if c not in values:
                            values[c] = (x[:, c] / length)[lists[c]]
                        spans.append((int(np.searchsorted(values[c], lo)), int(np.searchsorted(values[c], hi, side="right")), c, lo, hi))
                    spans.sort(key=lambda s: s[1] - s[0])
                    first = spans[0]
                    if (first[1] - first[0]) * 4 > len(ids):
                        whole.append(a)
                        continue
                    rest = lists[first[2]][first[0] : first[1]].astype(np.int64)
                    rest = rest[(labels[at[a]] == mine[rest]) == same]
                    for _, _, c, lo, hi in spans[1:]:
                        v = x[rest, c] / length[rest]
                        rest = rest[(v >= lo) & (v <= hi)]
                    if len(rest):
                        take(int(at[a]), ids[rest], products(own[a : a + 1], x[rest])[0])
                if whole:
                    dense(at[whole], x, own[whole], ids, mine)
                if sum(len(o[0]) for o in out) >= 100_000:
                    yield rows()
        yield rows()

    return packed.select("longest", "width", "ids", "labels", "data", "sorted").mapInArrow(run, "q long, win int, id long, score long")


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "win").orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _waves(packed: DataFrame, cuts: list[float], anchors: pa.Table, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """(q, win, id, score): the best ``k`` of all rows, wave by wave with a rising lower bound."""
    numbers, low, found = anchors["q"].to_numpy(), low.copy(), None
    order = np.argsort(numbers)
    edges = [None, *cuts, None]
    for above, below in zip(edges[:-1], edges[1:]):
        part = packed if above is None else packed.where(F.col("key") < above)
        part = part if below is None else part.where(F.col("key") >= below)
        new = search(part, anchors, low, high, same, k)
        found = stored(_first(new if found is None else found.union(new), k))
        if below is not None:
            last = found.groupBy("q", "win").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
            held = last.select("q", "win", "least").toArrow()
            at = order[np.searchsorted(numbers, held["q"].to_numpy(), sorter=order)]
            low[at, held["win"].to_numpy()] = np.maximum(low[at, held["win"].to_numpy()], held["least"].to_numpy())
    return found


def mine(table: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, scale: int = 256,
         band: tuple[int, int] = (30, 90), id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` reads the column ``id``; ``label``, a whole number, is made from columns of ``table``.
    Components are floor(``scale`` * x), a score is an inner product. The positives of an anchor are
    its best ``positives`` other rows of the same label; for each of them come the best
    ``negatives`` rows of another label with band[0] * p <= 100 * s <= band[1] * p, all if fewer. Larger
    scores come first, ties by smaller id, a null id last.

    Rows with a null label, a null vector or a null or non-finite component take no part. Vectors
    meet those of their own width only. Rows that repeat an id are anchors, positives and negatives
    of their own. Other columns, under any name, are not read. No anchors or rows give no rows.
    """
    rows = stored(whole_vectors(table, scale, id_col, vec, label))
    asked = rows.where(is_anchor)
    groups, count = blocks_of(stored(asked.select("label", "width", "data").distinct().withColumn("q", F.monotonically_increasing_id())))
    packed = buckets(first_copies(rows, max(positives + 1, negatives)))
    cuts = packed.agg(F.percentile_approx("key", [1 - w for w in WAVES], 10_000)).first()[0] or []
    near, far = [], []
    for b in range(count):
        anchors = block_rows(groups, b)
        shape = anchors.num_rows, positives
        shut = np.full((anchors.num_rows, 1), _LEAST)
        best = _waves(packed, cuts, anchors, shut, -shut, True, positives + 1)
        near.append(best.drop("win"))
        low, high = np.full(shape, 1, np.int64), np.zeros(shape, np.int64)
        for a, scores in enumerate(_positive_scores(best, anchors, positives)):
            for w, p in enumerate(scores):
                low[a, w], high[a, w] = -(-band[0] * p // 100), band[1] * p // 100
        far.append(_waves(packed, cuts, anchors, low, high, False, negatives))
    anchors = asked.withColumnRenamed("id", "anchor_id").join(groups, ["label", "width", "data"])
    near, far = (reduce(DataFrame.union, x).withColumn("down", -F.col("score")) for x in (near, far))
    near = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("down", "id"))).alias("near"))
    far = far.groupBy("q", "win").agg(F.array_sort(F.collect_list(F.struct("down", "id"))).alias("far"))
    own = F.array_position("near", F.struct((-F.col("square")).alias("down"), F.coalesce("anchor_id", F.lit(_NONE)).alias("id")))
    gone = F.when(own > 0, own).otherwise(positives + 1)
    pairs = anchors.join(near, "q").withColumn("gone", gone.cast("int")).withColumn(
        "near", F.slice(F.filter("near", lambda x, i: i + 1 != F.col("gone")), 1, positives))
    pairs = pairs.select("anchor_id", "q", F.array_distinct("near.down").alias("downs"), F.explode("near").alias("one"))
    pairs = pairs.withColumn("win", (F.array_position("downs", F.col("one.down")) - 1).cast("int"))
    found = pairs.join(far, ["q", "win"]).select("anchor_id", "one", F.posexplode("far").alias("pos", "other"))
    id_of = lambda c: F.nullif(F.col(f"{c}.id"), F.lit(_NONE))
    return found.select("anchor_id", id_of("one").alias("positive_id"), (F.col("pos") + 1).cast("int").alias("rank"),
                        id_of("other").alias("negative_id"), (-F.col("one.down")).alias("positive_score"),
                        (-F.col("other.down")).alias("negative_score"))


def _positive_scores(best: DataFrame, anchors: pa.Table, positives: int) -> list[list[int]]:
    """Distinct scores of the positives of each anchor vector, falling.

    One score is that of an anchor's own row, or the last one is one too many: all anchors of one vector
    and label are left with the same scores.
    """
    found = best.select("q", "score").toArrow().sort_by([("q", "ascending"), ("score", "descending")])
    q, scores, numbers = found["q"].to_numpy(), found["score"].to_numpy(), anchors["q"].to_numpy()
    out = []
    for start, end, data in zip(np.searchsorted(q, numbers), np.searchsorted(q, numbers, side="right"), anchors["data"].to_pylist()):
        own, left = np.frombuffer(bytearray(data), "<i4").astype(np.int64), scores[start:end].tolist()
        own = int(own @ own)
        left.remove(own) if own in left else left.pop()
        out.append(sorted({*left[:positives]}, reverse=True))
    return out
