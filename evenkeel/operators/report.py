"""Result tables: configuration products, missing and open work, ranking, top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.numeric import nan_to_null, try_double
from evenkeel.operators.prep import label_lookup

#: Names and order of methods, scalers and models in stored results.
METHODS = ["unbalanced", "csbboost", "hcbou", "smote"]
SCALERS = ["standard", "robust"]
MODELS = ["svm", "naive_bayes_gaussian", "decision_tree"]
MODEL_LABELS = {"svm": "SVM", "naive_bayes_gaussian": "Naive Bayes Gaussiano",
                "decision_tree": "Árbol de Decisión"}
#: Column order of the stored result tables.
WIDE_FIRST = ["dataset", "balancing_method", "scaler_type", "model", "model_label", "F1_Score", "Precision",
              "Recall", "Exactitud", "Error", "ROC_AUC", "PR_AUC", "training_time_seconds"]
CORE = ["dataset", "balancing_method", "scaler_type", "model_label", "TP", "FP", "FN", "TN", "F1_Score",
        "Precision", "Recall", "Especificidad", "Error", "ROC_AUC", "PR_AUC"]
TOP = ["dataset", "balancing_method", "scaler_type", "model_label", "TP", "FP", "FN", "TN", "F1_Score",
       "Precision", "Recall", "Especificidad", "Error", "PR_AUC", "ROC_AUC", "score"]
NUMERIC = ["TP", "FP", "FN", "TN", "F1_Score", "Precision", "Recall", "Especificidad", "Error", "ROC_AUC", "PR_AUC"]
#: Stored metric name of each metric column.
STORED = {"tp": "TP", "tn": "TN", "fp": "FP", "fn": "FN", "p": "P", "n": "N", "total": "Total",
          "error": "Error", "accuracy": "Exactitud", "tpr": "TP_Rate", "fpr": "FP_Rate",
          "precision": "Precision", "recall": "Recall", "sensitivity": "Sensibilidad",
          "specificity": "Especificidad", "f1": "F1_Score", "roc_auc": "ROC_AUC", "pr_auc": "PR_AUC"}

KEYS = ["dataset", "balancing_method", "scaler_type", "model"]


def stored_names(metrics: DataFrame) -> DataFrame:
    return metrics.withColumnsRenamed({k: v for k, v in STORED.items() if k in metrics.columns})


def configurations(datasets: DataFrame, methods=METHODS, scalers=SCALERS, models=MODELS) -> DataFrame:
    """Every (dataset, method, scaler, model); literal lists are exploded, nothing is cross-joined."""
    def lits(values):
        return F.explode(F.array(*[F.lit(v) for v in values]))

    return (datasets.select("dataset").distinct()
            .select("*", lits(methods).alias("balancing_method"))
            .select("*", lits(scalers).alias("scaler_type"))
            .select("*", lits(models).alias("model")))


def config_key(method: Column | str = "balancing_method", scaler: Column | str = "scaler_type") -> Column:
    return F.concat_ws("_", method, scaler)


def missing(configs: DataFrame, results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Configurations without a result."""
    return configs.join(results.select(*keys).distinct(), keys, "left_anti")


def todo(configs: DataFrame, done: DataFrame, keys: list[str] = KEYS, params: str = "best_params") -> DataFrame:
    """Work left: no record yet, or one that could not be parsed."""
    return missing(configs, done.where(F.col(params).isNotNull()), keys)


def with_best_params(configs: DataFrame, records: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return configs.join(records, keys)


def column_order(df: DataFrame, first: list[str]) -> DataFrame:
    """Listed columns that exist, then all others."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Listed columns that exist."""
    return df.select(*[c for c in cols if c in df.columns])


def to_numbers(df: DataFrame, cols: list[str] = NUMERIC) -> DataFrame:
    return df.withColumns({c: try_double(c) for c in cols if c in df.columns})


def pathology_filter(df: DataFrame, specificity: str = "Especificidad", error: str = "Error",
                     min_specificity: float = 0.2, max_error: float = 0.6) -> DataFrame:
    """Drops degenerate results; a missing metric never passes, an absent column is not checked."""
    out = df
    if specificity in df.columns:
        out = out.where(nan_to_null(F.col(specificity).cast("double")) >= min_specificity)
    if error in df.columns:
        out = out.where(nan_to_null(F.col(error).cast("double")) <= max_error)
    return out


def composite_score(df: DataFrame, weights: dict[str, float] | None = None, zero_fill=("PR_AUC",)) -> DataFrame:
    """Adds ``score``, the weighted sum; absent columns are added empty, ``zero_fill`` ones count 0."""
    weights = weights or {"Recall": 0.4, "F1_Score": 0.4, "PR_AUC": 0.2}
    for c in weights:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumns({c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0))
                         for c in weights if c in zero_fill})
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(w) * nan_to_null(F.col(c).cast("double"))
    return df.withColumn("score", total)


def _ties(df: DataFrame) -> list[Column]:
    """Load order of method, scaler and model, unknown names after the known ones; then the names themselves."""
    def at(col, values):
        pos = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col))
        return F.when(pos > 0, pos).otherwise(F.lit(len(values) + 1))

    order = [("balancing_method", METHODS), ("scaler_type", SCALERS), ("model", MODELS)]
    known = [at(c, values) for c, values in order if c in df.columns]
    return [*known, *[F.col(c) for c in ("balancing_method", "scaler_type", "model", "model_label") if c in df.columns]]


def top_n(df: DataFrame, n: int = 3, group: str = "dataset", score: str = "score",
          ties: list[Column | str] | None = None) -> DataFrame:
    """First n rows per group by score; ties in load order (method, scaler, model)."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), *(_ties(df) if ties is None else ties))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ranked(df: DataFrame, group: str = "dataset", score: str = "score") -> DataFrame:
    """Rows by group and falling score; ties in load order, so the order is total over configurations and models."""
    return df.orderBy(group, F.desc_nulls_last(score), *_ties(df))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Structs, maps and arrays as JSON text; scalars unchanged."""
    return df.select(*[
        F.to_json(F.col(f"`{n}`")).alias(n) if t.startswith(("struct", "map", "array")) else F.col(f"`{n}`")
        for n, t in df.dtypes])


def wide_table(results: DataFrame) -> DataFrame:
    """All metrics: key columns and display name first, nested values as JSON text."""
    named = results.withColumn("model_label", label_lookup(F.col("model"), MODEL_LABELS))
    return column_order(nested_as_json(named), WIDE_FIRST)


def core_table(results: DataFrame) -> DataFrame:
    named = results if "model_label" in results.columns else results.withColumn(
        "model_label", label_lookup(F.col("model"), MODEL_LABELS))
    return to_numbers(existing(named, [*CORE, "model"]))


def top_table(core: DataFrame, n: int = 3) -> DataFrame:
    best = top_n(composite_score(pathology_filter(core)), n)
    return existing(best, [*TOP, "rank"])


def config_summary(results: DataFrame, keys=("dataset", "balancing_method", "scaler_type")) -> DataFrame:
    """One nested record per configuration: model -> its metrics and matrix."""
    fields = ["F1_Score", "Exactitud", "Precision", "Recall", "Sensibilidad", "Especificidad", "Error",
              "TP_Rate", "FP_Rate", "ROC_AUC", "confusion_matrix"]
    entry = F.struct(*[F.col(c) for c in fields if c in results.columns])
    return results.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("model"), entry.alias("m"))))).alias("models"))


def best_params(scores: DataFrame, by: list[str], grid_index: str = "grid_index", score: str = "cv_score") -> DataFrame:
    """Mean fold score per combination, then the best one; the first of the grid wins ties."""
    mean = scores.groupBy(*by, grid_index).agg(F.avg(score).alias("mean_score"))
    return mean.groupBy(*by).agg(
        F.max_by(F.struct(grid_index, "mean_score"), F.struct(F.col("mean_score"), -F.col(grid_index))).alias("b")
    ).select(*by, f"b.{grid_index}", F.col("b.mean_score").alias("best_cv_score"))


def search_accounting(df: DataFrame, grids: dict[str, int], folds: int, features: str = "features") -> DataFrame:
    """Per model: combinations, folds, total fits, and the size of the data they run on."""
    size = df.agg(F.count(F.lit(1)).alias("n_samples"), F.max(F.size(features)).alias("n_features"))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).cast("long").alias("n_combinations"))
                               for m, c in grids.items()]))
    return size.select(rows.alias("g"), "n_samples", "n_features").select(
        "g.model", "g.n_combinations", F.lit(folds).alias("cv_folds"),
        (F.col("g.n_combinations") * folds).alias("total_fits"), "n_samples", "n_features")
