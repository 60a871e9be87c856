"""The three classifiers behind one interface: fit one, predict, and store."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import bayes, svm, trees
from evenkeel.operators.small import bounded_rows

NAMES = ["svm", "naive_bayes_gaussian", "decision_tree"]
#: Spark's depth limit; stands for an unlimited depth.
MAX_DEPTH = 30
SVM_FEATURES = 256


def tree_settings(params: dict) -> tuple[str, int, int]:
    """Nearest settings of Spark ML's tree: (impurity, depth, smallest node). It has no minimum
    size to split: a node of fewer
    than 2m rows cannot be split when both sides need m rows, so half of it is required
    on each side, which is stricter than the parameter asks for.
    """
    depth = MAX_DEPTH if params.get("max_depth") is None else int(params["max_depth"])
    leaf = max(int(params.get("min_samples_leaf", 1)), -(-int(params.get("min_samples_split", 2)) // 2))
    return params.get("criterion", "gini"), depth, leaf


def tree_spec(params: dict, fold: int | None = None) -> trees.TreeSpec:
    depth = params.get("max_depth")
    return trees.TreeSpec(params.get("criterion", "gini"), int(params.get("min_samples_split") or 2),
                          int(params.get("min_samples_leaf") or 1), fold, None if depth is None else int(depth))


def estimator(name: str, params: dict, rows: int | None = None, seed: int = 42):
    """Spark ML estimator over a ``vector`` column, for use in ``Pipeline``."""
    if name == "decision_tree":
        impurity, depth, leaf = tree_settings(params)
        return DecisionTreeClassifier(featuresCol="vector", labelCol="label", impurity=impurity, maxDepth=depth,
                                      minInstancesPerNode=leaf, seed=seed, maxMemoryInMB=512)
    if name == "svm" and params.get("kernel", "linear") == "linear":
        if not rows:
            raise ValueError("the linear SVM needs the number of training rows")
        return LinearSVC(featuresCol="vector", labelCol="label", regParam=1.0 / (params["C"] * rows),
                         standardization=False)
    raise ValueError(f"unknown model: {name}")


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.col(features).cast("array<double>")))


def fit(df: DataFrame, name: str, params: dict, seed: int = 42):
    """Model trained on all rows of ``df`` (``label``, ``features``)."""
    if name == "naive_bayes_gaussian":
        return bayes.fit(df, var_smoothing=float(params.get("var_smoothing", 1e-9)))
    if name == "svm":
        gamma = None
        if params.get("kernel", "rbf") == "rbf":
            gamma = svm.gamma_value(params.get("gamma", "scale"), *svm.entry_variance(df))
        return svm.fit_svms(df, [svm.Spec(float(params.get("C", 1.0)), gamma)], size=SVM_FEATURES, seed=seed)[0]
    if name == "decision_tree":
        return trees.fit_trees(df, [tree_spec(params)])[0]
    raise ValueError(f"unknown model: {name}")


def predict(df: DataFrame, model) -> DataFrame:
    """Adds ``y_pred INT`` and ``score``: probability of class 1, or the decision value."""
    if isinstance(model, bayes.GaussianNB):
        return bayes.predict(df, model)
    if isinstance(model, svm.SvmModel):
        return svm.predict(df, model)
    if isinstance(model, trees.Tree):
        return trees.predict(df, model)
    out = model.transform(with_vector(df))
    return out.select(*df.columns, F.col("prediction").cast("int").alias("y_pred"),
                      score_column(model).alias("score"))


def score_column(model):
    """Probability of class 1 where the model has one, else its raw decision value."""
    if hasattr(model, "getProbabilityCol"):
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


def save(spark: SparkSession, model, path: str) -> None:
    """Statistics, coefficients or nodes as a table; Spark ML models as their own folders."""
    if isinstance(model, bayes.GaussianNB):
        model.to_frame(spark).write.mode("overwrite").parquet(path)
    elif isinstance(model, svm.SvmModel):
        svm.to_frame(spark, [model]).write.mode("overwrite").parquet(path)
    elif isinstance(model, trees.Tree):
        trees.to_frame(spark, model).write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load(spark: SparkSession, name: str, path: str):
    if name == "naive_bayes_gaussian":
        rows = sorted(bounded_rows(spark.read.parquet(path)), key=lambda r: r["label"])
        return bayes.GaussianNB([r["label"] for r in rows], np.array([r["prior"] for r in rows]),
                                np.array([r["mean"] for r in rows]), np.array([r["var"] for r in rows]))
    if name == "svm":
        return svm.from_frame(spark.read.parquet(path))[0]
    if name == "decision_tree":
        return trees.from_frame(spark.read.parquet(path))
    raise ValueError(f"unknown model: {name}")
