"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, exact check.

A rotation is three rounds of random signs and a Walsh-Hadamard transform. The hash of a
vector is the signed axis its rotation is nearest to; a table joins two such hashes. A vector
lies in its own bucket of each table and also visits the buckets next in rank, so a pair is
found if one of the two lies where the other one lies or looks. Pairs are then checked with
the cosine in double precision. Equal vectors are one node and are counted, not paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import components, stored

#: Vectors of a bucket that one task compares with as many others.
BLOCK = 1024


def rotations(seed: int, count: int, width: int) -> np.ndarray:
    """Random signs, (count, 3, width)."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(count, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    x = x.copy()
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        a, b = y[:, :, 0].copy(), y[:, :, 1].copy()
        y[:, :, 0], y[:, :, 1] = a + b, a - b
        h *= 2
    return x / np.sqrt(width)


def probes(x: np.ndarray, signs: np.ndarray, tables: int, looks: int) -> np.ndarray:
    """(rows, tables, 1 + looks) bucket codes: the own bucket, then those it looks into."""
    n, width = x.shape
    out = np.empty((n, tables, 1 + looks), np.int64)
    for t in range(tables):
        axes, gaps = [], []
        for s in signs[2 * t : 2 * t + 2]:
            y = x
            for round_ in s:
                y = hadamard(y * round_)
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, :3]
            value = np.take_along_axis(y, order, 1)
            axes.append(order * 2 + (value < 0))
            top = np.abs(value)
            gaps.append((top[:, :1] - top) ** 2 / 2)
        # pairs of ranks, nearest first: the own pair costs 0
        cost = np.stack([gaps[0][:, i] + gaps[1][:, j] for i in range(3) for j in range(3)], 1)
        code = np.stack([axes[0][:, i] * (2 * width) + axes[1][:, j] for i in range(3) for j in range(3)], 1)
        pick = np.argsort(cost[:, 1:], axis=1, kind="stable")[:, :looks] + 1
        out[:, t, 0] = code[:, 0]
        out[:, t, 1:] = np.take_along_axis(code, pick, 1)
    return out


def vectors(table: DataFrame) -> DataFrame:
    """(id, label, vec array<double>) of the rows that can link: label and components set, finite, not all zero."""
    vec = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = table.select(F.col("vec_id").alias("id"), "label", vec.alias("vec")).where(
        "label is not null and vec is not null")
    return rows.where(~F.exists("vec", bad) & F.exists("vec", lambda v: v != 0))


def links(nodes: DataFrame, cosine: float, tables: int = 8, looks: int = 4, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of ``nodes`` (id, label, vec) with equal label and width and at least the cosine.

    Buckets of more than ``block`` vectors are cut into blocks, and every block meets every other
    one in a task of its own. The pairs that come back are those verified.
    """

    def hashed(batches):
        for batch in batches:
            vec = batch.column("vec")
            widths = vec.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                part = vec.take(pa.array(at))
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                padded = np.zeros((len(at), 1 << max(2, int(width - 1).bit_length())))
                padded[:, :width] = x
                codes = probes(padded, rotations(seed, 2 * tables, padded.shape[1]), tables, looks)
                n, per = len(at), codes.shape[1] * codes.shape[2]
                rows = np.repeat(np.arange(n), per)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(at)).take(pa.array(rows)),
                    batch.column("label").take(pa.array(at)).take(pa.array(rows)),
                    pa.array(np.full(n * per, width, np.int32)),
                    pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + looks), n)),
                    pa.array(codes.reshape(-1)),
                    pa.array(np.tile(np.arange(1 + looks) == 0, n * tables)),
                ], ["id", "label", "width", "tab", "code", "own"])

    label = nodes.schema["label"].dataType.simpleString()
    keys = ["label", "width", "tab", "code"]
    seats = stored(nodes.mapInArrow(hashed, f"id long, label {label}, width int, tab int, code long, own boolean"))
    # a bucket matters if something lies in it and it is visited twice
    sizes = seats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("lived")).where("n > 1 and lived")
    seats = seats.join(sizes.drop("lived"), keys)
    parts = F.ceil(F.col("n") / block).cast("int")
    seats = seats.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
        F.least("part", other).alias("x"), F.greatest("part", other).alias("y")))
    seats = seats.select(*keys, "id", "own", "part", F.explode(meet).alias("m")).select(*keys, "m.x", "m.y", "part", "id", "own")
    placed = seats.join(nodes.select("id", "vec"), "id")
    group = [*keys, "x", "y"]

    def verified(batches):
        def pairs(rows):
            lo = rows["part"].to_numpy() == rows["x"].to_numpy()
            a, b = (lo, lo) if rows["x"][0].as_py() == rows["y"][0].as_py() else (lo, ~lo)
            ids, own = rows["id"].to_numpy(), rows["own"].to_numpy()
            flat = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(len(ids), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = (x[a] @ x[b].T >= cosine) & (own[a][:, None] | own[b][None, :])
            i, j = np.nonzero(near)
            p, q = ids[a][i], ids[b][j]
            keep = p < q if a is b else p != q
            return np.minimum(p, q)[keep], np.maximum(p, q)[keep]

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            change = np.zeros(t.num_rows - 1, bool)
            for c in group:
                v = t[c].combine_chunks().to_numpy(zero_copy_only=False)
                change |= v[1:] != v[:-1]
            bounds = [0, *(np.flatnonzero(change) + 1).tolist()]
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s > 1:
                    a, b = pairs(t.slice(s, e - s))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held = t.slice(bounds[-1])
        if held is not None and held.num_rows > 1:
            a, b = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ready = placed.repartition(*group).sortWithinPartitions(*group)
    return ready.mapInArrow(verified, "a long, b long").distinct()


def near_duplicates(table: DataFrame, cosine: float = 0.93, **settings) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table`` (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine is at least ``cosine``. Rows without
    a label, and vectors that are null, zero or hold null or non-finite values, link with nothing.
    Equal vectors always link. Every row is indexed; ``settings`` are those of ``links``. Rows that share
    an id are rows of their own, each kept if its component has no smaller id; a null id is the largest,
    and a component of null ids alone has a null id.
    """
    ids = table.select(F.col("vec_id").alias("id"), "label", "embedding")
    good = stored(vectors(table))
    groups = good.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # a vector's number is its own, whatever ids its rows have
    groups = stored(groups.withColumn("node", F.monotonically_increasing_id()))
    pairs = stored(links(groups.select(F.col("node").alias("id"), "label", "vec"), cosine, **settings))
    roots = components(pairs)
    weight = groups.select("node", "copies")
    far = pairs.join(weight, pairs["a"] == weight["node"]).select(F.col("b").alias("node"), "copies").union(
        pairs.join(weight, pairs["b"] == weight["node"]).select(F.col("a").alias("node"), "copies"))
    far = far.groupBy("node").agg(F.sum("copies").alias("others"))
    placed = stored(groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("vec", "label"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = placed.join(least, "root").join(far, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id")
    nodes = stored(groups.select("node", "label", "vec").join(nodes, "node").drop("node"))
    vec = F.col("embedding").cast("array<double>")
    out = ids.select("id", F.col("label").alias("l"), vec.alias("v")).join(
        nodes, (F.col("l") == F.col("label")) & (F.col("v") == F.col("vec")), "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
