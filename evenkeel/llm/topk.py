"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores over a few lists: the inner products over slices of the
components. All queries of a block are sought at once.

1. Each task keeps the best entries of each list for each query; the best of all tasks are
   resolved exactly, and the k-th best exact score is a cutoff that the k-th best of all rows
   cannot lie below.
2. The cutoff is broadcast. A row whose partial scores all lie below cutoff / lists cannot reach
   it, so each list sends only entries of at least that much; rows that all lists sent are complete.
   Entries below the bound count as the bound less one, and rows whose sum cannot reach the
   cutoff stay behind.
3. The cutoff rises to the k-th best complete score; rows that may still reach it are resolved.

Queries pass through the driver block by block, with a checked number of bytes; rows never do.
Equal query vectors are one query, and of equal vectors only the first k + 1 ids are sought.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import stored
from evenkeel.llm.vectors import block_rows, blocks_of, first_copies, matrix, products, whole_vectors

#: Queries and rows of one matrix product.
_QUERIES, _ROWS = 1024, 2048
_LEAST = -(2**62)


def _parts(batches, width_of: dict[int, np.ndarray], lists: int):
    """(batch rows, uids, ids, query numbers, partial scores by list) of slices of rows and queries with equal widths."""
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths):
            if int(width) not in width_of:
                continue
            at = np.flatnonzero(widths == width)
            numbers, q = width_of[int(width)]
            cuts = np.linspace(0, width, lists + 1).astype(int)
            for k in range(0, len(at), _ROWS):
                some = pa.array(at[k : k + _ROWS])
                x = matrix(batch.column("data").take(some), int(width))
                uids = batch.column("uid").take(some).to_numpy()
                for j in range(0, len(numbers), _QUERIES):
                    own = q[j : j + _QUERIES]
                    yield uids, numbers[j : j + _QUERIES], [products(own[:, a:b], x[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _by_width(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    widths, numbers = table["width"].to_numpy(), table["q"].to_numpy()
    out = {}
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[int(width)] = numbers[at], matrix(table["data"].take(pa.array(at)), int(width))
    return out


def _best(rows: DataFrame, by: list[str], order: list, count: int, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= count)


def _local_lists(rows: DataFrame, shared, lists: int, count: int) -> DataFrame:
    """(q, list, uid, part): each task's best ``count`` entries of each list and query."""

    def run(batches):
        width_of, held = _by_width(shared.value), {}
        for uids, numbers, parts in _parts(batches, width_of, lists):
            for at, p in enumerate(parts):
                key = (int(numbers[0]), at)
                uid = np.broadcast_to(uids, p.shape)
                if key in held:
                    p, uid = np.hstack((held[key][1], p)), np.hstack((held[key][2], uid))
                if p.shape[1] > count:
                    top = np.argpartition(p, p.shape[1] - count, axis=1)[:, -count:]
                    p, uid = np.take_along_axis(p, top, 1), np.take_along_axis(uid, top, 1)
                held[key] = numbers, p, uid
        for (_, at), (numbers, p, uid) in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(numbers, p.shape[1])), pa.array(np.full(p.size, at, np.int32)),
                pa.array(np.ascontiguousarray(uid).reshape(-1)), pa.array(p.reshape(-1))], ["q", "list", "uid", "part"])

    return rows.select("uid", "width", "data").mapInArrow(run, "q long, list int, uid long, part long")


def _resolved(pairs: DataFrame, rows: DataFrame, shared) -> DataFrame:
    """(q, uid, score) of ``pairs`` (q, uid), exact. A row meets at most the queries of one block."""

    def run(batches):
        held = {}
        for width, (numbers, x) in _by_width(shared.value).items():
            held[width] = numbers, x, np.argsort(numbers)
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                numbers, x, order = held[int(width)]
                at = np.flatnonzero(widths == width)
                asked = batch.column("qs").take(pa.array(at))
                sizes = asked.value_lengths().to_numpy(zero_copy_only=False)
                q = asked.flatten().to_numpy()
                mine = matrix(batch.column("data").take(pa.array(at)), int(width))
                row = np.repeat(np.arange(len(at)), sizes)
                uids = batch.column("uid").take(pa.array(at)).to_numpy()
                place = order[np.searchsorted(numbers, q, sorter=order)]
                for k in range(0, len(q), _ROWS * 8):
                    some = slice(k, k + _ROWS * 8)
                    a, b = x[place[some]], mine[row[some]]
                    wide = int(width) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) >= 2**53
                    score = np.einsum("ij,ij->i", *((a.astype(np.int64), b.astype(np.int64)) if wide else (a, b))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(q[some]), pa.array(uids[row[some]]), pa.array(score)], ["q", "uid", "score"])

    asked = pairs.groupBy("uid").agg(F.collect_list("q").alias("qs"))
    return rows.select("uid", "width", "data").join(asked, "uid").mapInArrow(run, "q long, uid long, score long")


def _entries(rows: DataFrame, shared, cutoffs, lists: int) -> DataFrame:
    """(q, uid, known, missing, score) of rows that a list sends and that may reach the cutoff; ``score`` where all lists sent."""

    def run(batches):
        width_of, (numbers_all, least_all) = _by_width(shared.value), cutoffs.value
        for uids, numbers, parts in _parts(batches, width_of, lists):
            least = least_all[np.searchsorted(numbers_all, numbers)][:, None]
            share = -(-least // lists)
            known, missing, sent = np.zeros(parts[0].shape, np.int64), np.zeros(parts[0].shape, np.int8), np.zeros(parts[0].shape, bool)
            for p in parts:
                here = p >= share
                sent |= here
                known += np.where(here, p, 0)
                missing += ~here
            may = sent & ((missing == 0) | (known + missing * (share - 1) >= least)) & ((missing > 0) | (known >= least))
            i, j = np.nonzero(may)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[i]), pa.array(uids[j]), pa.array(known[i, j]),
                                                  pa.array(missing[i, j].astype(np.int32))], ["q", "uid", "known", "missing"])

    return rows.select("uid", "width", "data").mapInArrow(run, "q long, uid long, known long, missing int")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(q, least): the k-th best score of each query that has so many."""
    return _best(scores, ["q"], [F.desc("score")], k).where(F.col("place") == k).select("q", F.col("score").alias("least"))


def _block(rows: DataFrame, queries: pa.Table, k: int, lists: int, seeds: int) -> DataFrame:
    """(q, uid, score): the rows that may be among the best k of each query of a block, scores exact."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(queries.select(["q", "width", "data"]))
    local = _best(_local_lists(rows, shared, lists, seeds), ["q", "list"], [F.desc("part"), "uid"], seeds)
    first = stored(_resolved(local.select("q", "uid").distinct(), rows, shared))
    least = {r.q: r.least for r in _kth(first, k).toLocalIterator()}
    numbers = np.sort(queries["q"].to_numpy())
    cutoffs = spark.sparkContext.broadcast((numbers, np.array([least.get(int(q), _LEAST) for q in numbers], np.int64)))
    sent = stored(_entries(rows, shared, cutoffs, lists))
    complete = sent.where("missing = 0").select("q", "uid", F.col("known").alias("score"))
    risen = stored(_kth(first.union(complete).distinct(), k))
    share = {r.q: r.least for r in risen.toLocalIterator()}
    # the bound of a list stays that of phase 2; what must be reached has risen
    bounds = numbers, np.array([-(-least.get(int(q), _LEAST) // lists) - 1 for q in numbers]), np.array([share.get(int(q), _LEAST) for q in numbers])

    def open_(batches):
        for batch in batches:
            at = np.searchsorted(bounds[0], batch.column("q").to_numpy())
            most = batch.column("known").to_numpy() + batch.column("missing").to_numpy() * bounds[1][at]
            yield batch.select(["q", "uid"]).filter(pa.array(most >= bounds[2][at]))

    rest = sent.where("missing > 0").mapInArrow(open_, "q long, uid long")
    return complete.union(_resolved(rest, rows, shared))


def top_k(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, lists: int = 2, id_col: str = "vec_id",
          vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of ``table`` with the largest inner products for each row where ``is_query``.

    ``is_query`` reads the column ``id``. Components are floor(``scale`` * x). Every row but the query's
    own one is a candidate; all come back if there are fewer than ``k``. Ties go to the smaller id, a
    null id last. Rows with a null vector or a null or non-finite component take no part. Vectors meet
    those of their own width only; empty ones score 0. Repeated rows, and rows that share an id, are
    candidates and queries of their own. Other columns, under any name, are not read.
    """
    rows = stored(whole_vectors(table, scale, id_col, vec))
    asked = rows.where(is_query)
    queries, count = blocks_of(stored(asked.select("label", "width", "data").distinct().withColumn("q", F.monotonically_increasing_id())))
    # one more than k, for a query may find itself
    sought = stored(first_copies(rows, k + 1).withColumn("uid", F.monotonically_increasing_id()))
    found = [_block(sought, block_rows(queries, b), k + 1, lists, 4 * (k + 1)) for b in range(count)]
    found = reduce(DataFrame.union, found).join(sought.select("uid", "id", F.col("data").alias("at")), "uid")
    best = stored(_best(found, ["q"], [F.desc("score"), F.col("id").asc_nulls_last(), "uid"], k + 1))
    best = best.join(queries.select("q", "data"), "q").groupBy("q").agg(F.array_sort(F.collect_list(F.struct(
        "place", "id", "score", (F.col("at") == F.col("data")).alias("same")))).alias("best"))
    own = asked.select(F.col("id").alias("query_id"), "width", "data").join(queries.select("q", "width", "data"), ["width", "data"]).join(best, "q")
    # a row is no candidate of its own: one copy with its id goes, or else the one too many
    own = own.withColumn("gone", F.coalesce(F.expr("get(filter(best, x -> x.same and x.id = query_id), 0).place"), F.lit(k + 1)))
    left = F.filter("best", lambda x: x["place"] != F.col("gone"))
    return own.select("query_id", F.posexplode(left).alias("pos", "one")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.id").alias("id"), F.col("one.score").alias("score"))
