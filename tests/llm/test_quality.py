import numpy as np
from brute import remainder

from evenkeel.llm import quality, queries


def test_query_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op5_quality_classifier"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (remainder(r.doc_id, 4) == 2) for r in got)
    held = [r for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.93 * len(held)


def test_ftrl_equals_the_formula_step_by_step():
    rng = np.random.default_rng(0)
    model = quality.Ftrl(6)
    z, n = np.zeros(7), np.zeros(7)
    for _ in range(40):
        at = np.sort(rng.choice(7, 3, replace=False))
        x, y = rng.random(3), int(rng.integers(2))
        w = np.array([0 if abs(z[i]) <= model.l1 else -(z[i] - np.sign(z[i]) * model.l1) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)
                      for i in at])
        p = 1 / (1 + np.exp(-(w * x).sum()))
        for k, i in enumerate(at):
            g = (p - y) * x[k]
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / model.alpha * w[k]
            n[i] += g * g
        model.learn(at, x, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_features_do_not_cross_texts():
    memory = quality.Pieces()
    both, sizes = quality.features(["a b!! 12", "", "c"], memory)
    alone = [quality.features([t], memory)[0].tolist() for t in ("a b!! 12", "", "c")]
    assert both.tolist() == sum(alone, []) and sizes.tolist() == [7, 0, 1]


def test_odd_rows(spark):
    rows = [(1, "good good text"), (1, "good good text"), (2, "bad $$$"), (3, None), (4, ""), (5, "x " * 60_000), (None, "good")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, label int, order int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, None), (9, 1)], "doc_id long, label int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4] and by[1] > by[2]
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []
