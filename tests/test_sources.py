"""CSV, partitioned Parquet and JSON records round trip; broken and missing files are told apart."""

import json

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import rank, report
from evenkeel.sources import results, tables


def record(**over):
    base = {"TP": 7, "TN": 136, "FP": 15, "FN": 7, "P": 14, "N": 151, "Total": 165, "Error": 22 / 165,
            "Exactitud": 143 / 165, "Recall": 0.5, "F1_Score": 7 / 18, "Precision": 7 / 22, "Especificidad": 136 / 151,
            "ROC_AUC": 0.75, "PR_AUC": 0.35, "confusion_matrix": [[136, 15], [7, 7]],
            "best_hyperparameters": {"C": 10, "gamma": 0.01, "kernel": "rbf"}, "training_time_seconds": 0.004}
    return {**base, **over}


def put(root, method, dataset, scaler, name, text):
    folder = root / method / dataset / scaler
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, True), (2, -1.0, False)], "row_id long, f0 double, RealBug boolean")
    tables.write_csv(df, str(tmp_path / "x"))
    schema = "row_id long, f0 double, RealBug boolean"
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "x"), schema).collect())) == sorted(map(tuple, df.collect()))
    named = tables.read_dataset(spark, str(tmp_path / "x"), "d1")
    assert named.first()["dataset"] == "d1" and named.count() == 2


def test_row_ids_do_not_depend_on_the_files(spark, tmp_path):
    rows = [(f"f{i % 7}", float(i % 3) - 1, None if i % 5 == 0 else i % 2 == 0) for i in range(900)]
    rows += [("hot, line", -0.0, True)] * 500 + [("", 0.0, None), (None, 0.0, None), ("n", float("nan"), None)]
    schema = "`my name` string, f0 double, RealBug boolean"
    df = spark.createDataFrame(rows, schema)
    seen = []
    for n in (1, 3, 40):
        path = str(tmp_path / f"x{n}")
        df.orderBy(F.xxhash64("f0", F.lit(n))).repartition(n).write.option("header", True).option("emptyValue", '""').csv(path)
        got = tables.read_dataset(spark, path, "d1", schema, row_id="row_id")
        assert got.columns == ["my name", "f0", "RealBug", "row_id", "dataset"]
        seen.append(sorted((r["row_id"], str(r["my name"]), str(r["f0"]), r["RealBug"]) for r in got.collect()))
        assert [r[0] for r in seen[-1]] == list(range(len(rows)))
    assert seen[0] == seen[1] == seen[2]


def test_row_ids_of_hot_copies_and_odd_columns(spark):
    hot = spark.range(2500).select(F.lit("a").alias("v.w"), F.lit(7).alias("row_id"))
    df = hot.union(spark.createDataFrame([("b", 1), (None, 2), ("", 3), ("b", 4)], "`v.w` string, row_id int"))
    got = rank.row_ids(df, copy_run=100)
    plan = got.collect()
    assert sorted(r.row_id for r in plan) == list(range(2504))
    ids = {}
    for r in plan:
        ids.setdefault(r["v.w"], []).append(r.row_id)
    assert {k: len(v) for k, v in ids.items()} == {"a": 2500, "b": 2, None: 1, "": 1}
    assert all(max(v) - min(v) == len(v) - 1 for v in ids.values())
    assert got.rdd.getNumPartitions() > 1 and rank.row_ids(df.limit(0)).collect() == []


def test_phase_layout_prunes_and_overwrites_one_key(spark, tmp_path):
    path = str(tmp_path / "phase")
    df = spark.createDataFrame([("smote", "d", "standard", s, i) for i, s in enumerate(["train", "test"])]
                               + [("hcbou", "d", "standard", "train", 9)],
                               "method string, dataset string, scaler string, split string, x int")
    tables.write_phase(df, path)
    tables.write_phase(df.where("method = 'smote' and split = 'train'").withColumn("x", F.lit(100)), path)
    train, test = tables.train_test(spark, path, method="smote", dataset="d", scaler="standard")
    assert [r["x"] for r in train.collect()] == [100] and [r["x"] for r in test.collect()] == [1]
    assert tables.read_phase(spark, path, method="hcbou").count() == 1
    assert "PartitionFilters: [isnotnull(method" in train._jdf.queryExecution().executedPlan().toString()


def test_predictions_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0.9)], "y_true int, y_pred int, score double")
    tables.write_predictions(df, str(tmp_path / "p"))
    assert tables.read_csv(spark, str(tmp_path / "p")).columns == ["y_true", "y_pred", "y_proba"]


def test_result_tables_from_json(spark, tmp_path):
    for method, f1, spec in (("smote", 0.5, 0.9), ("csbboost", 0.4, 0.1), ("hcbou", 0.3, 0.8)):
        put(tmp_path, method, "d-1.0", "standard", "svm_final_metrics.json",
            json.dumps(record(F1_Score=f1, Especificidad=spec), indent=2))
    put(tmp_path, "smote", "d-1.0", "robust", "svm_final_metrics.json", "{ broken")
    df = results.read_metrics(spark, str(tmp_path))
    assert df.count() == 3 and {r["dataset"] for r in df.select("dataset").collect()} == {"d-1.0"}
    wide = report.wide_table(df)
    assert wide.columns[:6] == ["dataset", "balancing_method", "scaler_type", "model", "model_label", "F1_Score"]
    assert json.loads(wide.first()["confusion_matrix"]) == [[136, 15], [7, 7]]
    top = report.top_table(report.core_table(df)).orderBy("rank").collect()
    assert [r["balancing_method"] for r in top] == ["smote", "hcbou"] and top[0]["model_label"] == "SVM"
    assert top[0]["score"] == pytest.approx(0.4 * 0.5 + 0.4 * 0.5 + 0.2 * 0.35)
    configs = report.configurations(spark.createDataFrame([("d-1.0",)], "dataset string"), models=["svm"])
    assert configs.count() == 8 and report.missing(configs, df).count() == 5


def test_broken_tuning_record_is_done_again(spark, tmp_path):
    good = {"best_params": {"var_smoothing": 1e-9}, "best_cv_score": 0.8, "test_metrics": {"f1_score": 0.2}}
    put(tmp_path, "smote", "d", "standard", "naive_bayes_gaussian_best_params.json", json.dumps(good))
    put(tmp_path, "smote", "d", "robust", "naive_bayes_gaussian_best_params.json", '{"best_params": ')
    done = results.read_tuning(spark, str(tmp_path))
    configs = report.configurations(spark.createDataFrame([("d",)], "dataset string"), ["smote"], models=["naive_bayes_gaussian"])
    assert [r["scaler_type"] for r in report.todo(configs, done).collect()] == ["robust"]
    assert report.with_best_params(configs, done).where("best_cv_score = 0.8").count() == 1


def test_record_sink(spark, tmp_path):
    df = spark.createDataFrame([("m", "d", 0.5)], "method string, dataset string, score double")
    results.write_records(df, str(tmp_path / "r"), ["method", "dataset"])
    assert results.read_records(spark, str(tmp_path / "r"), "score double, method string, dataset string").first()["score"] == 0.5
