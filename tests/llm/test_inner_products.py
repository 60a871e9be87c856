"""Exact top-k search and hard negatives against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import hardneg, queries, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, q long, id string, data int, score int"


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))



def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, e, lab, 5, "x", 1, 2) for i, e, lab in rows], SCHEMA).repartition(parts)


def whole(rows, scale):
    out = []
    for i, e, lab in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            top = vectors.most(len(e))
            out.append((i, [max(-top, min(top, math.floor(scale * x))) for x in e], lab))
    return out


def in_order(x):
    return -x[0], x[1] is None, x[1] or 0


def brute_top(rows, k=10, scale=1024, every=100):
    good, out = whole(rows, scale), []
    for n, (i, q, _) in enumerate(good):
        if i is not None and i % every == 0:
            scores = [(sum(a * b for a, b in zip(q, c)), j) for m, (j, c, _) in enumerate(good) if m != n and len(c) == len(q)]
            out += [(i, r, j, s) for r, (s, j) in enumerate(sorted(scores, key=in_order)[:k], 1)]
    return sorted(out, key=str)


def brute_negatives(rows, every=100):
    good, out = [], []
    for i, v, lab in whole(rows, 256):
        lab = (lab + 1) % 10 if lab is not None and i is not None and i % 7 == 0 else lab
        if lab is not None:
            good.append((i, v, lab))
    for n, (i, q, lab) in enumerate(good):
        if i is not None and i % every == 0:
            scores = [(sum(a * b for a, b in zip(q, c)), j, other) for m, (j, c, other) in enumerate(good) if m != n and len(c) == len(q)]
            positives = sorted((x for x in scores if x[2] == lab), key=in_order)[:5]
            for p, j, _ in positives:
                fit = sorted((x for x in scores if x[2] != lab and 30 * p <= 100 * x[0] <= 90 * p), key=in_order)[:10]
                out += [(i, j, r, m, p, s) for r, (s, m, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def cloud(seed, n, width, labels=4, coarse=False, lengths=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for k in range(n):
        x = centres[k % 6] * (k % 3) + rng.normal(size=width)
        x = x / np.linalg.norm(x) * (rng.lognormal(0, 1) if lengths else 1)
        x = np.round(x * 4) / 4 if coarse else x
        rows.append((int(rng.integers(0, 40)) * 50 if k % 5 == 0 else k, [float(v) for v in x], int(rng.integers(0, labels))))
    return rows


ODD = [(100, None, 1), (200, [0.0] * 4, 1), (300, [1.0, None, 0.0, 0.0], 1), (400, [float("nan"), 1.0, 0.0, 0.0], 1),
       (500, [float("inf"), 1.0, 0.0, 0.0], 1), (600, [1.0, 0.0, 0.0, 0.0], 1), (700, [2.0, 0.5, 0.0, 0.0], None), (None, [1.0, 1.0, 0.0, 0.0], 2),
       (None, [1.0, 1.0, 0.0, 0.0], 1), (800, [], 1), (900, [], 2), (1000, [3.0], 1), (1001, [4.0], 2), (1002, [5.0], 1), (600, [1.0, 0.0, 0.0, 0.0], 1),
       (600, [0.5, 9.0, 0.0, 0.0], 1), (1100, [1e30, -1e30, 2.0, 0.0], 1), (1200, [1e9, 1.0, 0.0, 3.0], 1), (21, [0.4, 0.1, 0.0, 0.0], 3),
       (22, [0.5, 0.0, 0.25, 0.0], 3), (1300, [0.75, 0.0, 0.0, 0.0], 1)]


@pytest.mark.parametrize("rows", [cloud(1, 300, 16), cloud(2, 400, 5, coarse=True), cloud(3, 200, 8, lengths=True), ODD, ODD * 13],
                         ids=["cloud", "ties", "lengths", "odd", "copies"])
def test_top_k(spark, rows):
    df = topk.top_k(frame(spark, rows), F.col("id") % 100 == 0)
    assert df.columns == ["query_id", "rank", "id", "score"]
    assert got(df) == brute_top(rows)


@pytest.mark.parametrize("lists", [1, 3])
def test_lists_and_blocks(spark, monkeypatch, lists):
    rows = cloud(4, 250, 12)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4096)
    assert got(topk.top_k(frame(spark, rows), F.col("id") % 2 == 0, k=3, lists=lists)) == brute_top(rows, k=3, every=2)


@pytest.mark.parametrize("rows", [cloud(5, 300, 16), cloud(6, 400, 5, coarse=True), cloud(7, 300, 8, lengths=True), ODD, ODD * 13],
                         ids=["cloud", "ties", "lengths", "odd", "copies"])
def test_hard_negatives(spark, rows):
    assert got(hardneg.mine(frame(spark, rows), F.col("id") % 100 == 0, label())) == brute_negatives(rows)


def test_buckets_and_waves(spark, monkeypatch):
    """Small buckets, several blocks of anchors; near copies, so that ranges exclude rows."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(20):
        centre = rng.normal(size=12)
        for _ in range(20):
            x = centre + rng.normal(size=12) * 0.1
            rows.append((len(rows), [float(v) for v in x / np.linalg.norm(x)], int(rng.integers(0, 3))))
    monkeypatch.setattr(hardneg, "BUCKET_ROWS", 16)
    monkeypatch.setattr(hardneg.buckets, "__defaults__", (16,))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 2048)
    assert got(hardneg.mine(frame(spark, rows), F.col("id") % 20 == 0, label())) == brute_negatives(rows, every=20)


def test_ranges_hold_the_cap():
    rng = np.random.default_rng(9)
    for _ in range(200):
        q, p = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 5)))
        least, most = hardneg._ranges(q, float(q @ p), np.arange(5))
        assert (least <= p).all() and (p <= most).all()


def test_products_stay_exact():
    a = np.array([[2**29 - 1, 3], [1, 2]], float)
    assert vectors.products(a, a).tolist() == [[(2**29 - 1) ** 2 + 9, 2**29 + 5], [2**29 + 5, 5]]


def test_empty_tables(spark):
    assert got(topk.top_k(frame(spark, []), F.col("id") % 100 == 0)) == []
    assert got(hardneg.mine(frame(spark, []), F.col("id") % 100 == 0, label())) == []
    none = [(1, [1.0], 1), (2, [2.0], 2)]
    assert got(topk.top_k(frame(spark, none), F.col("id") % 100 == 0)) == []
    assert got(hardneg.mine(frame(spark, none), F.col("id") % 100 == 0, label())) == []


def test_queries(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(queries.QUERIES["op11_exact_top_k"](spark, sf)) == brute_top(rows)
    assert got(queries.QUERIES["op13_hard_negatives"](spark, sf)) == brute_negatives(rows)
