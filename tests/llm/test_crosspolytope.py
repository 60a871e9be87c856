import numpy as np
from brute import embedding_links

from evenkeel.llm import crosspolytope as C
from evenkeel.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, lab, "x", 1, 2) for i, e, lab in rows], SCHEMA)


def near_groups(seed=3, groups=25, size=8, width=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=width)
        for k in range(size):
            v = centre + rng.normal(size=width) * rng.uniform(0.02, 0.3)
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], g % 3))
    return rows


def test_recall_and_precision(spark):
    rows = near_groups()
    rows += [(1000 + i, rows[0][1], 0) for i in range(50)]
    want = embedding_links(rows)
    got = {r.vec_id: r for r in C.near_duplicates(frame(spark, rows)).collect()}
    found, all_ = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert 0.95 * all_ <= found <= all_
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_give_the_same_pairs(spark):
    nodes = C.vectors(frame(spark, near_groups(groups=6, size=30)))
    pairs = lambda **k: {tuple(r) for r in C.links(nodes, 0.93, **k).collect()}
    assert pairs(block=4) == pairs() != set()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0] * 4, 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [nan, 1.0, 0.0, 0.0], 1), (5, [inf, 1.0, 0.0, 0.0], 1),
            (6, [1.0, 0.0, 0.0, 0.0], 1), (7, [2.0, 0.0, 0.0, 0.0], 1), (8, [1.0, 0.0, 0.0, 0.0], None), (9, [1.0, 0.0, 0.0, 0.0], 2),
            (10, [], 1), (11, [3.0], 1), (12, [4.0], 1), (13, [1e-30, 0.0, 0.0, 0.0], 1), (14, [1.0, 0.0, 0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in C.near_duplicates(frame(spark, rows)).collect()}
    assert got == embedding_links(rows)
    assert C.near_duplicates(frame(spark, [])).collect() == []


def test_rows_that_share_an_id(spark):
    """One row out per row in; a component's id is the smallest of all its rows."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.99, 0.1, 0.0, 0.0]
    rows = [(1, a, 1), (1, a, 1), (3, a, 1), (3, b, 1), (2, c, 1), (None, b, 1), (None, None, 1), (7, a, None), (7, [0.0] * 4, 1)]
    got = sorted(map(tuple, C.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (3, 3, 1, False), (3, 1, 3, True), (2, 3, 1, False), (None, 1, 3, False),
                          (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True)], key=str)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(C.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(C.hadamard(C.hadamard(x)), x)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op10_embedding_near_dedup"](spark, sf).collect()}
    assert got == embedding_links(rows)
