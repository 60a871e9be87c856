"""Models against plain numpy, grids, leak checks and whole runs."""

import gc
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.kernels import list_column, matrix
from evenkeel.operators import bayes, cluster, models, rank, svm, trees, tuning
from evenkeel.plans import flow


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (90, 4)), rng.normal(1.8, 1, (30, 4))])
    y = [0] * 90 + [1] * 30
    df = spark.createDataFrame([(i, y[i], x[i].tolist()) for i in range(120)],
                               "row_id long, label int, features array<double>").repartition(3)
    return df, x, np.array(y)


def test_naive_bayes_matches_numpy(blobs):
    df, x, y = blobs
    model = bayes.fit(df, var_smoothing=1e-3)
    eps = 1e-3 * x.var(0).max()
    for c in (0, 1):
        assert model.mean[c] == pytest.approx(x[y == c].mean(0))
        assert model.var[c] == pytest.approx(x[y == c].var(0) + eps)
    got = bayes.predict(df, model).orderBy("row_id").toPandas()
    joint = np.stack([np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * model.var[c]) + (x - model.mean[c]) ** 2 / model.var[c]).sum(1)
                      for c in (0, 1)], 1)
    assert (got["y_pred"].to_numpy() == joint.argmax(1)).all()
    assert got["score"].to_numpy() == pytest.approx(1 / (1 + np.exp(joint[:, 0] - joint[:, 1])))


def test_linear_svm_reaches_the_optimum_spark_finds(blobs):
    df, x, y = blobs
    s, cost = 2 * y - 1, 1.0

    def objective(w, b):
        return 0.5 * w @ w / (cost * len(x)) + np.maximum(0, 1 - s * (x @ w + b)).mean()

    mine = svm.fit_svms(df, [svm.Spec(cost)])[0]
    other = models.estimator("svm", {"C": cost, "kernel": "linear"}, len(x)).fit(models.with_vector(df))
    assert objective(mine.weights, mine.intercept) <= objective(other.coefficients.toArray(), other.intercept) * 1.02 + 0.005


def test_fourier_features_approach_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (30, 5))
    z = svm.fourier_features(x, 0.1, *svm.fourier_draws(2000, 5))
    true = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - true).max() < 0.12


def test_fold_models_equal_separate_fits(blobs):
    df, _, _ = blobs
    folded = rank.stratified_folds(df, "label", "row_id", 3)
    shared = svm.fit_svms(folded, [svm.Spec(1.0, None, f) for f in range(3)], fold="fold")
    scores = svm.recalls(folded, shared, fold="fold")
    for f in range(3):
        alone = svm.fit_svms(folded.where(F.col("fold") != f), [svm.Spec(1.0)])[0]
        got = svm.recalls(folded.where(F.col("fold") == f), [alone])[0]
        assert scores[f] == pytest.approx(got, abs=0.11)


def test_svm_on_repeated_rows(spark):
    df = spark.range(6000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                                  F.when(F.col("id") % 3 == 0, F.array(F.lit(2.0), F.lit(1.0))).otherwise(F.array(F.lit(-1.0), F.lit(0.5))).alias("features"))
    model = svm.fit_svms(df, [svm.Spec(1.0)])[0]
    assert svm.predict(df, model).where("y_pred <> label").count() == 0


def test_svm_reads_all_rows_at_every_size(spark):
    """Small tables take the same passes as large ones: the same weights for any number of partitions and of copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) + np.array([[1.5, 0, 0]]) * (np.arange(200) % 2)[:, None]
    rows = [(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    many = df.crossJoin(spark.range(20).select(F.col("id").alias("copy"))).drop("copy")
    one = svm.fit_svms(df.repartition(1), [svm.Spec(1.0)])[0]
    for other in (df.repartition(7), many.repartition(5)):
        cost = 1.0 if other is not many and other.count() == 200 else 1.0 / 20
        model = svm.fit_svms(other, [svm.Spec(cost)])[0]
        assert np.allclose(model.weights, one.weights, atol=1e-2) and abs(model.intercept - one.intercept) < 1e-2


def test_grids():
    assert [tuning.nominal_size(m) for m in models.NAMES] == [72, 6, 160]
    assert len({tuning.effective("svm", p) for p in tuning.combinations("svm")}) == 42
    with pytest.raises(ValueError):
        tuning.combinations("forest")
    assert models.tree_settings({"max_depth": None, "min_samples_leaf": 1, "min_samples_split": 5}) == ("gini", 30, 3)
    assert svm.gamma_value("auto", 4, 2.0) == 0.25 and svm.gamma_value("scale", 4, 2.0) == 0.125


def brute_tree(x, y, spec, depth=0):
    """Reference growth by plain recursion over all values as thresholds; nodes as (pos, neg, children)."""
    n, pos = len(y), int(y.sum())
    node = [n - pos, pos, None]
    if pos in (0, n) or n < spec.min_split or depth == spec.max_depth:
        return node

    def imp(p, n):
        q = np.array([p / n, 1 - p / n])
        return 1 - (q**2).sum() if spec.criterion == "gini" else -sum(v * np.log2(v) for v in q if v > 0)

    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            m = x[:, j] <= t
            if min(m.sum(), n - m.sum()) >= spec.min_leaf:
                s = round((m.sum() * imp(y[m].sum(), m.sum()) + (n - m.sum()) * imp(y[~m].sum(), n - m.sum())) / n, 12)
                if best is None or s < best[0]:
                    best = (s, j, t)
    if best:
        m = x[:, best[1]] <= best[2]
        node[2] = (best[1], best[2], brute_tree(x[m], y[m], spec, depth + 1), brute_tree(x[~m], y[~m], spec, depth + 1))
    return node


def test_shared_trees_equal_trees_grown_alone(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (150, 3)).astype(float)
    y = ((x[:, 0] > 6) ^ (rng.random(150) < 0.2)).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), i % 3) for i in range(150)],
                               "row_id long, label int, features array<double>, fold int").repartition(4)
    specs = [trees.TreeSpec(c, s, m, f, d) for c in ("gini", "entropy") for s, m, f, d in
             [(2, 1, None, None), (10, 1, 0, None), (5, 4, 1, 3), (2, 8, 2, None)]]
    for spec, tree in zip(specs, trees.fit_trees(df, specs, fold="fold")):
        keep = np.arange(150) % 3 != spec.fold if spec.fold is not None else np.ones(150, bool)

        def walk(node, at):
            assert tree.counts[at].tolist() == node[:2]
            if node[2] is None:
                assert tree.left[at] == at
            else:
                assert (tree.feature[at], tree.threshold[at]) == node[2][:2]
                walk(node[2][2], tree.left[at])
                walk(node[2][3], tree.right[at])

        walk(brute_tree(x[keep], y[keep], spec), 0)


def test_executors_choose_the_same_splits(spark, monkeypatch):
    """Splits chosen by (node, feature) in a shuffle equal those of one place, ties included, for any partitions."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (120, 3)).astype(float)
    x[:, 2] = x[:, 1]  # equal gains: the lower feature counts
    y = ((x[:, 0] + x[:, 1] > 3) ^ (rng.random(120) < 0.2)).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), i % 2) for i in range(120)],
                               "row_id long, label int, features array<double>, fold int")
    specs = [trees.TreeSpec("gini", 2, 1, None, 3), trees.TreeSpec("entropy", 12, 5, 1, None), trees.TreeSpec("gini", 2, 70)]
    want = trees.fit_trees(df.repartition(4), specs, fold="fold")
    assert len(want[2].left) == 1 and len(want[0].left) > 3
    monkeypatch.setattr(trees, "DRIVER_CELLS", 0)
    for parts in (1, 4, 64):
        for a, b in zip(want, trees.fit_trees(df.repartition(parts), specs, fold="fold")):
            for name in ("feature", "threshold", "left", "right", "counts"):
                assert np.array_equal(getattr(a, name), getattr(b, name))


def test_tasks_grow_the_same_trees_and_scores(spark, monkeypatch):
    """Trees grown below small nodes in tasks equal those of shared passes, and so do the scores of a grid; passes do not follow the nodes."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, (160, 3)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 8) ^ (rng.random(160) < 0.3)).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), i % 2) for i in range(160)],
                               "row_id long, label int, features array<double>, fold int").repartition(3)
    depths = [0, 2, 4, None]
    specs = [trees.TreeSpec(c, s, m, f) for c in ("gini", "entropy") for s, m, f in ((2, 1, 0), (12, 1, 1), (2, 6, 0), (2, 1, None))]
    specs.append(trees.TreeSpec("gini", 2, 1, 1, 4))
    monkeypatch.setattr(trees, "LOCAL_ROWS", 0)
    want = trees.fit_trees(df, specs, fold="fold")
    scores = trees.recalls(df, want, depths, fold="fold")
    shape = lambda t, at=0: (t.counts[at].tolist(), None if t.left[at] == at else (
        t.feature[at], t.threshold[at], shape(t, t.left[at]), shape(t, t.right[at])))
    passes, histograms = [], trees._histograms
    monkeypatch.setattr(trees, "_histograms", lambda *a: (passes.append(1), histograms(*a))[1])
    for limit, most in ((8192, 1), (40, 8)):
        monkeypatch.setattr(trees, "LOCAL_ROWS", limit)
        passes.clear()
        assert [shape(t) for t in trees.fit_trees(df, specs, fold="fold")] == [shape(t) for t in want]
        assert len(passes) <= most
        assert trees.grid_recalls(df, df, specs, depths, fold="fold") == scores


def test_depth_grid_comes_from_one_tree(blobs):
    df, _, _ = blobs
    full = trees.fit_trees(df, [trees.TreeSpec()])[0]
    cut = trees.fit_trees(df, [trees.TreeSpec(max_depth=2)])[0]
    by = trees.recalls(df, [full], [2, None])[0]
    assert by[2] == trees.recalls(df, [cut], [None])[0][None] and by[None] >= 0.9


def test_unknown_model_is_an_error(blobs):
    with pytest.raises(ValueError):
        models.fit(blobs[0], "forest", {})


def test_failure_is_a_record(spark, blobs):
    bad = blobs[0].withColumn("fold", F.lit(0)).drop("features")
    rec = tuning.tune(bad, ["naive_bayes_gaussian"]).first()
    assert rec["best_params"] is None and rec["error"]


@pytest.mark.parametrize("name,params", [("svm", {"C": 1.0, "kernel": "rbf", "gamma": "scale"}),
                                         ("naive_bayes_gaussian", {}), ("decision_tree", {"max_depth": 3})])
def test_models_learn_and_survive_storage(spark, blobs, tmp_path, name, params):
    df, _, y = blobs
    model = models.fit(df, name, params)
    pred = models.predict(df, model).orderBy("row_id").toPandas()
    assert (pred["y_pred"].to_numpy() == y).mean() > 0.85
    models.save(spark, model, str(tmp_path / name))
    again = models.predict(df, models.load(spark, name, str(tmp_path / name))).orderBy("row_id").toPandas()
    assert again["score"].to_numpy() == pytest.approx(pred["score"].to_numpy())


def test_impurity_gain(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "x double, label int")
    r = trees.split_gains(df, {"x": [2.0]}).first()
    assert r["gini_gain"] == pytest.approx(0.5) and r["entropy_gain"] == pytest.approx(1.0) and r["left"] == 2


def test_validation_rows_are_never_parents(blobs):
    df, _, _ = blobs
    folded = rank.stratified_folds(df, "label", "row_id", 3)
    ready = tuning.prepared_folds(folded, "fold", flow.preparer("smote", "standard"))
    for f in range(3):
        train, valid = ready(f)
        held = {r[0] for r in valid.select("row_id").collect()}
        used = {v for r in train.select("row_id", "parent_id", "neighbour_id").collect() for v in r if v is not None}
        assert not held & used and held


def test_whole_run(spark):
    rng = np.random.default_rng(2)
    data = []
    for name in ("a", "b"):
        for i in range(80):
            bug = i % 4 == 0
            v = rng.normal(1.5 if bug else 0, 1, 3)
            data.append((name, i, "t", *[float(q) for q in v], bug, 1))
    raw = spark.createDataFrame(data, "dataset string, row_id long, note string, f0 double, f1 double, f2 double, RealBug boolean, HeuBug int")
    rows = flow.preprocess(raw)
    assert rows.groupBy("dataset", "split").count().where("split = 'test' and count = 16").count() == 2
    grids = {"decision_tree": {"max_depth": [3], "min_samples_split": [2], "min_samples_leaf": [1], "criterion": ["gini"]}}
    table, pred, tuned = flow.run(rows, ["unbalanced", "smote"], ["robust"], ["naive_bayes_gaussian", "decision_tree"],
                                  order="reference", grids=grids)
    got = table.collect()
    assert len(got) == 8 and all(r["Total"] == 16 and r["TP"] + r["FN"] == 4 for r in got)
    assert pred.count() == 8 * 16 and tuned.where("error is null").count() == 8
    again, _, new = flow.run(rows.where("dataset = 'a'"), ["smote"], ["robust"], ["naive_bayes_gaussian"],
                             order="reference", done=tuned)
    assert new is None and again.count() == 1


def test_feature_maps_are_made_for_few_rows_at_a_time(spark, monkeypatch):
    """A batch of any size is mapped in pieces, one map at a time, with the same sums."""
    rng = np.random.default_rng(3)
    x, y, fold = rng.normal(size=(500, 4)), np.sign(rng.normal(size=500)), rng.integers(0, 2, 500).astype(np.int32)
    specs = [svm.Spec(1.0, g, f) for g in (None, 0.1, 1.0, 3.0) for f in (0, 1)]
    run = svm._Pass(4, 16, 42)
    weights = [rng.normal(size=(4 if s.gamma is None else 16) + 1) for s in specs]
    whole = svm._losses(run, specs, weights, 20, x, y, fold)
    monkeypatch.setattr(svm, "MAP_ROWS", 64)
    batch = pa.RecordBatch.from_arrays([list_column(x), pa.array(y), pa.array(fold)], names=["x", "y", "fold"])
    pieces = list(svm._pieces([batch]))
    assert max(p.num_rows for p in pieces) == 64 and sum(p.num_rows for p in pieces) == 500
    parts = sum(svm._losses(run, specs, weights, 20, matrix(p.column("x")), p.column("y").to_numpy(), p.column("fold").to_numpy()) for p in pieces)
    assert np.allclose(parts, whole)
    held = []
    for _, z in run.blocks(x, specs):
        if z is not x:
            gc.collect()
            assert sum(r() is not None for r in held) == 0
            held.append(weakref.ref(z))
        del z


def test_few_cells_reach_the_driver(spark):
    """A pass over the 32 nodes of a fifth level in 60 partitions is judged in tasks."""
    parts = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 1.0), (3, 4.0)], "cell long, n double")
    parts.toArrow = None  # partial counts must not be collected
    found = trees._splits(parts, 32, 64, 64, 60, lambda k, counts: {("gini", 1)} if min(counts) > 0 else set())
    assert found[0] == ((4.0, 5.0), {("gini", 1): (0, 0)}) and found[1] == ((0.0, 0.0), {})


@pytest.mark.parametrize("block_rows", [None, 7])
def test_exact_silhouette_by_products(spark, block_rows):
    """Far from the origin, with copies and near copies; each two blocks meet once, for both sides."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) + 1e4
    x[1], x[2], x[3] = x[0], x[0] + 1e-7, x[0]
    c = rng.integers(0, 3, 60)
    c[59] = 9  # alone
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(60)], "row_id long, cluster int, features array<double>")
    got = {r["row_id"]: r["silhouette"] for r in cluster.silhouette_exact(df, block_rows=block_rows).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(60):
        own = (c == c[i]).sum()
        a = d[i, c == c[i]].sum() / max(own - 1, 1)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        assert abs(got[i] - (0.0 if own == 1 else (b - a) / max(a, b))) < 1e-9
