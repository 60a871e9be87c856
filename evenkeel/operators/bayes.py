"""Gaussian naive Bayes from class moments: fit, predict and a whole grid search in two passes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.kernels import list_column, matrix
from evenkeel.functions.numeric import safe_divide
from evenkeel.operators.scale import moments
from evenkeel.operators.small import bounded_rows, local_frame


def _merge(parts: list[tuple[float, np.ndarray, np.ndarray]]):
    """Count, mean, population variance of disjoint parts taken together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    var = sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / n
    return n, mean, var


@dataclass
class GaussianNB:
    classes: list[int]
    prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray  # smoothed

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log prior plus log likelihood, rows x classes."""
        inv = 1.0 / self.var
        const = np.log(self.prior) - 0.5 * np.log(2 * np.pi * self.var).sum(1)
        out = np.empty((len(x), len(self.classes)))
        for i in range(len(self.classes)):
            out[:, i] = const[i] - 0.5 * ((x - self.mean[i]) ** 2 @ inv[i])
        return out

    def to_frame(self, spark) -> DataFrame:
        return local_frame(
            spark, [(int(c), float(p), m.tolist(), v.tolist())
                    for c, p, m, v in zip(self.classes, self.prior, self.mean, self.var)],
            "label int, prior double, mean array<double>, var array<double>")


def from_moments(stats: dict[int, tuple], var_smoothing: float = 1e-9) -> GaussianNB:
    """Model from class -> (n, mean, var); smoothing adds its share of the largest feature variance."""
    classes = sorted(stats)
    n, _, var = _merge([stats[c] for c in classes])
    eps = var_smoothing * float(var.max())
    return GaussianNB(classes, np.array([stats[c][0] / n for c in classes]),
                      np.array([stats[c][1] for c in classes]),
                      np.array([stats[c][2] + eps for c in classes]))


def class_moments(df: DataFrame, by: list[str], features: str = "features") -> list:
    return [(tuple(r[c] for c in by), (float(r["n"]), np.asarray(r["mean"]), np.asarray(r["var"])))
            for r in bounded_rows(moments(df, by, features))]


def fit(df: DataFrame, label: str = "label", features: str = "features",
        var_smoothing: float = 1e-9) -> GaussianNB:
    """One partial aggregate per class; only class-level moments reach the driver."""
    return from_moments({k[0]: v for k, v in class_moments(df, [label], features)}, var_smoothing)


def predict(df: DataFrame, model: GaussianNB, features: str = "features") -> DataFrame:
    """Adds ``y_pred`` and ``score`` (probability of the last class). Map-only."""
    @F.arrow_udf("array<double>")
    def posterior(v: pa.Array) -> pa.Array:
        z = model.log_joint(matrix(v))
        z = np.exp(z - z.max(1, keepdims=True))
        return list_column(z / z.sum(1, keepdims=True))

    probs = df.withColumn("_p", posterior(F.col(features).cast("array<double>")))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    classes = F.array(*[F.lit(int(c)) for c in model.classes])
    return probs.select(*df.columns, F.get(classes, best - 1).alias("y_pred"),
                        F.get("_p", F.lit(len(model.classes) - 1)).alias("score"))


def grid_predictions(df: DataFrame, smoothings: list[float], fold: str = "fold",
                     label: str = "label", features: str = "features") -> DataFrame:
    """Out-of-fold class of every row under every smoothing: ``fold``, label, ``preds`` ARRAY<INT>.

    Moments per (fold, class) come from one aggregate; the training moments of a fold are
    those of all other folds merged, so nothing is fitted twice.
    """
    stats = class_moments(df, [fold, label], features)
    folds = sorted({k[0] for k, _ in stats})
    models = {}
    for f in folds:
        parts: dict[int, list] = {}
        for (g, c), m in stats:
            if g != f:
                parts.setdefault(c, []).append(m)
        train = {c: _merge(p) for c, p in parts.items()}
        models[f] = [from_moments(train, s) for s in smoothings]

    @F.arrow_udf("array<int>")
    def out_of_fold(v: pa.Array, f: pa.Array) -> pa.Array:
        x, at = matrix(v), f.to_numpy(zero_copy_only=False)
        out = np.zeros((len(x), len(smoothings)), np.int32)
        for g in np.unique(at):
            rows = np.nonzero(at == g)[0]
            for j, model in enumerate(models[int(g)]):
                out[rows, j] = np.asarray(model.classes, np.int32)[model.log_joint(x[rows]).argmax(1)]
        return list_column(out)

    return df.select(fold, label, out_of_fold(
        F.col(features).cast("array<double>"), F.col(fold).cast("int")).alias("preds"))


def grid_search(df: DataFrame, smoothings: list[float], fold: str = "fold", label: str = "label",
                features: str = "features", positive: int = 1) -> DataFrame:
    """Recall per (combination, fold): ``grid_index``, ``var_smoothing``, ``fold``, ``cv_score``."""
    preds = grid_predictions(df, smoothings, fold, label, features)
    values = F.array(*[F.lit(float(s)) for s in smoothings])
    hits = preds.where(F.col(label) == positive).select(fold, F.posexplode("preds").alias("grid_index", "p"))
    return hits.groupBy("grid_index", fold).agg(
        safe_divide(F.sum(F.when(F.col("p") == positive, 1).otherwise(0)), F.count(F.lit(1))).alias("cv_score")
    ).select("grid_index", F.get(values, F.col("grid_index")).alias("var_smoothing"), fold, "cv_score")
