"""Small cases with answers worked out by hand, and the edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import half_even, hash_key, hash_uniform
from evenkeel.functions.kernels import nearest
from evenkeel.operators import balance as B
from evenkeel.operators import cluster, metrics, prep, quantiles, rank, report, scale


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def labelled(spark, counts, width=2):
    """row_id, label, features; classes in blocks, features spread on a line per class."""
    data, i = [], 0
    for label, n in counts.items():
        for j in range(n):
            data.append((i, label, [float(10 * label + j * 0.1), float(j % 7)][:width]))
            i += 1
    return rows(spark, data, "row_id long, label int, features array<double>")


def counts(df, *by):
    return {tuple(r[c] for c in by) if len(by) > 1 else r[by[0]]: r["count"] for r in df.groupBy(*by).count().collect()}


def test_hash_uniform(spark):
    df = rows(spark, [(7,)], "id long").select(hash_uniform(hash_key(42, "id")).alias("u"))
    assert df.first()["u"] == pytest.approx(0.46435326454, abs=1e-11)


def test_half_even(spark):
    df = rows(spark, [(2.5,), (3.5,)], "x double").select(half_even(F.col("x")).alias("r"))
    assert [r["r"] for r in df.collect()] == [2, 4]


@pytest.mark.parametrize("task_rows", [100_000, 2])
def test_quantiles_interpolate(spark, task_rows):
    df = rows(spark, [(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], task_rows)[0] == [1.75, 2.5, 4.75]


@pytest.mark.parametrize("sizes,test", [
    ({0: 751, 1: 70}, {0: 151, 1: 14}), ({0: 841, 1: 218}, {0: 168, 1: 44}), ({0: 644, 1: 87}, {0: 130, 1: 17})])
def test_split_sizes(spark, sizes, test):
    df = rows(spark, [(c, n) for c, n in sizes.items()], "label int, n long")
    assert {r["label"]: r["quota"] for r in rank.split_quotas(df, "label", 0.2).collect()} == test


@pytest.mark.parametrize("train,target", [({0: 600, 1: 56}, 328), ({0: 514, 1: 70}, 292)])
def test_smote_counts(spark, train, target):
    out = B.balance(labelled(spark, train), "smote")
    assert counts(out, "label") == {0: target, 1: target}


@pytest.mark.parametrize("method", ["csbboost", "hcbou"])
def test_clustered_methods_balance(spark, method):
    out = B.balance(labelled(spark, {0: 60, 1: 20}), method, n_init=2)
    got = counts(out, "label")
    assert abs(got[0] - 40) <= 5 and abs(got[1] - 40) <= 6
    assert out.select("row_id", "copy").distinct().count() == out.count()
    if method == "hcbou":
        assert got[0] == 40


def metric_case(spark):
    cells = {(1, 1): 7, (0, 0): 136, (0, 1): 15, (1, 0): 7}
    return rows(spark, [(y, p) for (y, p), n in cells.items() for _ in range(n)], "y_true int, y_pred int")


def test_metrics_from_one_matrix(spark):
    r = metrics.evaluate(metric_case(spark), []).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["p"], r["n"], r["total"]) == (7, 136, 15, 7, 14, 151, 165)
    want = {"error": 0.1333333333, "accuracy": 0.8666666667, "precision": 0.3181818182, "recall": 0.5,
            "specificity": 0.9006622517, "f1": 0.3888888889}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-9)
    assert r["confusion_matrix"] == [[136, 15], [7, 7]] and r["roc_auc"] is None
    assert metrics.identity_violations(metrics.evaluate(metric_case(spark), [])).count() == 0
    rep = {x["entry"]: x for x in metrics.classification_report(metric_case(spark), []).collect()}
    assert rep["macro avg"]["f1"] == pytest.approx(0.6570294785, abs=1e-9)
    assert rep["weighted avg"]["f1"] == pytest.approx(0.8796674225, abs=1e-9)


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_curves_with_ties(spark, ranges):
    df = rows(spark, [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1)], "y_true int, score double")
    pts = sorted((round(r["recall"], 6), round(r["precision"], 6)) for r in metrics.pr_curve(df, [], ranges=ranges).collect())
    assert pts == sorted([(0.0, 1.0), (0.333333, 1.0), (0.666667, 0.666667), (0.666667, 0.5), (1.0, 0.6)])
    assert metrics.area_under_curves(df, [], ranges=ranges).first()["roc_auc"] == pytest.approx(0.5833333333)


def test_no_predicted_positives_and_one_class(spark):
    df = rows(spark, [(0, 0, 0.1), (0, 0, 0.2)], "y_true int, y_pred int, score double")
    r = metrics.evaluate(df, []).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["roc_auc"] is None and r["tn"] == 2
    assert metrics.ovr_auc(df, []).first()["ovr_auc"] == 0.5


def test_ovr_auc_map(spark):
    df = rows(spark, [(0, 0), (1, 1), (2, 1), (2, 2)], "y_true int, y_pred int")
    m = metrics.ovr_auc(df, [], average=None).first()["ovr_auc"]
    assert m[0] == 1.0 and m[2] == 0.75 and m[1] == pytest.approx((1 + 2 / 3) / 2)


def clustered(spark, sizes):
    """Rows of {(label, cluster): n}, vectors near a corner of their cluster."""
    data, i = [], 0
    for (label, cluster), n in sizes.items():
        for _ in range(n):
            data.append((i, label, cluster, [float(cluster or 0) * 10 + (i * 37 % 101) / 50, float(label or 0) + (i * 53 % 97) / 50]))
            i += 1
    return rows(spark, data, "row_id long, label int, cluster int, features array<double>")


def test_classes_share_the_rows_evenly(spark):
    sizes = {(0, 0): 50, (0, 1): 31, (1, 0): 20, (1, 5): 2, (2, 0): 9, (2, 1): 1, (None, 0): 4}
    df = clustered(spark, sizes)
    quotas = {(r["label"], r["cluster"]): r for r in B.class_cluster_quotas(df).collect()}
    total = sum(sizes.values())
    by_class = {}
    for (label, _), r in quotas.items():
        by_class[label] = by_class.get(label, 0) + r["quota"]
    assert total == 117 and by_class == {0: 30, 1: 29, 2: 29, None: 29}
    assert {r["branch"] for r in quotas.values()} == {"shrink", "copy", "grow"}
    out = B.balance_classes(df)
    got = {(r["label"], r["cluster"]): r["count"] for r in out.groupBy("label", "cluster").count().collect()}
    assert got == {k: r["quota"] for k, r in quotas.items()}
    assert out.select("row_id", "copy").distinct().count() == out.count() == total
    kept = {r["row_id"] for r in out.where("copy = 0 and not is_synthetic").collect()}
    assert kept == {r["row_id"] for r in df.where("label <> 0 or label is null").collect()}  # growing classes keep all rows
    # a new row lies between two rows of its own class and cluster
    group = {r["row_id"]: (r["label"], r["cluster"]) for r in df.collect()}
    for r in out.where("is_synthetic and neighbour_id is not null").collect():
        assert group[r["parent_id"]] == group[r["neighbour_id"]] == (r["label"], r["cluster"])


def test_classes_of_even_size_and_no_rows_stay(spark):
    df = clustered(spark, {(0, 0): 7, (1, 0): 7, (2, 3): 7})
    out = B.balance_classes(df)
    assert sorted(r["row_id"] for r in out.where("not is_synthetic").collect()) == list(range(21)) and out.count() == 21
    assert B.balance_classes(df.limit(0)).collect() == []


def test_equal_class_counts_give_two_labels(spark):
    r = B.majority_minority(rows(spark, [(1, 5), (0, 5)], "label int, n long")).first()
    assert (r["majority"], r["minority"]) == (0, 1)


def test_three_classes(spark):
    df = labelled(spark, {0: 9, 1: 5, 2: 3})
    for method in ("smote", "csbboost", "hcbou"):  # they know two classes; none may be lost
        with pytest.raises(ValueError, match="3 classes"):
            B.balance(df, method)
        with pytest.raises(ValueError, match="1 classes"):
            B.balance(df.where("label = 0"), method)
    assert counts(B.balance(df, "unbalanced"), "label") == {0: 9, 1: 5, 2: 3}
    assert counts(B.random_undersample(df), "label") == {0: 8, 1: 5, 2: 3}


def test_minority_smaller_than_k(spark):
    out = B.balance(labelled(spark, {0: 20, 1: 3}), "smote", k=5)
    assert counts(out, "label") == {0: 11, 1: 11}
    lone = labelled(spark, {1: 1})
    q = rows(spark, [(1, 1, 4)], "label int, n long, quota long")
    assert B.smote(lone, ["label"], q).count() == 0


def test_cluster_between_quota_and_double(spark):
    df = labelled(spark, {1: 10}).withColumn("cluster", F.lit(0))
    out = B.balance_per_cluster(df, "cluster", 15, 3)
    assert out.count() == 15 and out.where("not is_synthetic").count() == 10
    single = labelled(spark, {1: 1}).withColumn("cluster", F.lit(0))
    copies = B.balance_per_cluster(single, "cluster", 4, 3)
    assert copies.count() == 4 and copies.select("features").distinct().count() == 1


def test_synthetic_rows_lie_on_segments(spark):
    df = labelled(spark, {0: 40, 1: 12})
    out = B.balance(df, "smote").where("is_synthetic").collect()
    x = {r["row_id"]: r["features"] for r in df.collect()}
    for r in out:
        a, b, t = x[r["parent_id"]], x[r["neighbour_id"]], r["lambda"]
        assert r["parent_id"] != r["neighbour_id"] and 0 <= t < 1
        assert r["features"] == pytest.approx([p + t * (q - p) for p, q in zip(a, b)])


def test_all_k_too_small_falls_back_to_one(spark):
    model, table = cluster.choose_k(labelled(spark, {0: 8}), 2, 4, min_cluster_rows=7, n_init=1)
    assert model.k == 1 and all(t["silhouette"] == -1.0 for t in table)
    assert cluster.choose_k(labelled(spark, {0: 2}), 2, 10)[0].k == 1


def test_constant_and_zero_range_columns(spark):
    df = rows(spark, [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    std, rob = scale.fit_standard(df, ["a", "c"]), scale.fit_robust(df, ["a", "c"])
    assert std.scale[1] == 1.0 and rob.scale[1] == 1.0 and std.scale[0] == pytest.approx(math.sqrt(2 / 3))
    vec = prep.assemble(df, ["a", "c"])
    assert scale.fit_standard_vector(vec).scale == pytest.approx(std.scale)
    assert scale.fit_robust_vector(vec).center == rob.center
    with pytest.raises(ValueError):
        scale.fit_scaler(vec, "minmax")


def test_alignment_and_drops(spark):
    df = rows(spark, [(1, 2.0, "x")], "a int, b double, s string")
    with pytest.raises(ValueError):
        prep.align(df, ["a", "missing"])
    assert prep.align(df, ["b", "a"]).columns == ["b", "a"]
    assert prep.drop_if_present(df, ["HeuBug", "s"]).columns == ["a", "b"]
    assert prep.numeric_columns(rows(spark, [(1, 2, 3.0)], "a tinyint, b int, c float"), restricted=True) == ["b", "c"]


def test_null_target_stops(spark):
    df = rows(spark, [(True,), (None,)], "t boolean")
    with pytest.raises(Exception, match="null in target"):
        prep.cast_target(df, "t").collect()


def test_bad_metrics_never_pass(spark):
    df = rows(spark, [("a", float("nan"), 0.1), ("b", None, 0.1), ("c", 0.5, 0.1), ("d", 0.5, 0.7)],
              "dataset string, Especificidad double, Error double")
    assert [r["dataset"] for r in report.pathology_filter(df).collect()] == ["c"]
    assert report.pathology_filter(df.select("dataset")).count() == 4
    text = rows(spark, [("n/a", 0.5, 0.5)], "PR_AUC string, Recall double, F1_Score double")
    scored = report.composite_score(report.to_numbers(text, ["PR_AUC"])).first()
    assert scored["score"] == pytest.approx(0.4)


def test_top_n_ties_in_load_order(spark):
    df = rows(spark, [("d", m, s, "svm", 0.5) for m in ("smote", "csbboost") for s in ("robust", "standard")],
              "dataset string, balancing_method string, scaler_type string, model string, score double")
    got = [(r["balancing_method"], r["scaler_type"]) for r in report.top_n(df, 3).orderBy("rank").collect()]
    assert got == [("csbboost", "standard"), ("csbboost", "robust"), ("smote", "standard")]


def test_folds_of_tiny_classes(spark):
    df = labelled(spark, {0: 7, 1: 2})
    out = counts(rank.stratified_folds(df, "label", "row_id", 3), "label", "fold")
    assert out == {(0, 0): 3, (0, 1): 2, (0, 2): 2, (1, 0): 1, (1, 1): 1}


def test_presets(spark):
    df = labelled(spark, {0: 3, 1: 2})
    r = B.recommended_params(df).first()
    assert (r["scenario"], r["max_clusters_maj"], r["k_smote"]) == ("binary_classification", 8, 3)
    assert B.recommended_params(labelled(spark, {0: 3, 1: 2, 2: 2})).first()["min_cluster_obs"] == 3
    assert B.recommended_params(df, scenario="other").first()["scenario"] == "binary_classification"


def test_nearest_centre_far_from_the_origin(spark):
    df = rows(spark, [(i, [1e9 + i]) for i in range(11)], "row_id long, features array<double>")
    centers = np.array([[1e9], [1e9 + 10]])
    got = [r["cluster"] for r in cluster.assign_nearest(df, centers).orderBy("row_id").collect()]
    assert got == [0] * 6 + [1] * 5  # the middle is a tie
    near, best = nearest(np.array([[1e9 + 4.0], [1e9 + 7.0]]), centers)
    assert near.tolist() == [0, 1] and best.tolist() == [16.0, 9.0]
    spread = cluster.silhouettes(df, [cluster.Clustering(2, centers, 0.0)])[0]
    home = cluster.silhouettes(df.withColumn("features", F.expr("transform(features, x -> x - 1e9)")),
                               [cluster.Clustering(2, centers - 1e9, 0.0)])[0]
    assert spread == pytest.approx(home, abs=1e-9)


def test_ranking_ties_end_in_load_order(spark):
    data = [("d", m, s, k, 0.5) for k in ("other", "decision_tree", "svm") for s in ("robust", "new") for m in ("smote", "odd", "unbalanced")]
    df = rows(spark, data, "dataset string, balancing_method string, scaler_type string, model string, score double").repartition(5)
    order = [(r.balancing_method, r.scaler_type, r.model) for r in report.head(report.ranked(df), 18).collect()]
    assert order == [(m, s, k) for m in ("unbalanced", "smote", "odd") for s in ("robust", "new") for k in ("svm", "decision_tree", "other")]
    best = report.top_n(df, 3).orderBy("rank").collect()
    assert [(r.balancing_method, r.scaler_type, r.model) for r in best] == order[:3]
