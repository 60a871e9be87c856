"""Grid search: every fit of a grid shares passes where the model allows it.

A ``prepare`` function resamples and scales inside each fold (leak-free); without one the
rows are taken as already balanced and scaled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import bayes, models, svm, trees
from evenkeel.operators.metrics import basic_metrics
from evenkeel.operators.scale import moments
from evenkeel.operators.small import bounded_rows, local_frame
from evenkeel.sources.results import stamp

#: The parameter lists of the three models.
GRIDS = {
    "svm": {
        "C": [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0],
        "kernel": ["linear", "rbf"],
        "gamma": ["0.001", "0.01", "0.1", "1", "scale", "auto"],
    },
    "naive_bayes_gaussian": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4]},
    "decision_tree": {
        "max_depth": [3, 5, 10, 20, None],
        "min_samples_split": [2, 5, 10, 20],
        "min_samples_leaf": [1, 2, 4, 8],
        "criterion": ["gini", "entropy"],
    },
}

Prepare = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def combinations(model: str, grid: dict | None = None) -> list[dict]:
    """All combinations in grid order (parameters by name, the last one fastest)."""
    if grid is None:
        if model not in GRIDS:
            raise ValueError(f"unknown model: {model}")
        grid = GRIDS[model]
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]


def nominal_size(model: str) -> int:
    return len(combinations(model))


def effective(model: str, params: dict) -> tuple:
    """What a combination really trains; combinations with equal values are fitted once."""
    if model == "svm":
        return params["kernel"], float(params["C"]), params["gamma"] if params["kernel"] == "rbf" else None
    if model == "decision_tree":
        return params["criterion"], params["min_samples_split"], params["min_samples_leaf"], params["max_depth"]
    return (float(params["var_smoothing"]),)


def grid_frame(spark, model: str, grid: dict | None = None) -> DataFrame:
    """One row per combination; parameters as text, since their types differ."""
    rows = [(model, i, {k: None if v is None else str(v) for k, v in p.items()})
            for i, p in enumerate(combinations(model, grid))]
    return spark.createDataFrame(rows, "model string, grid_index int, params map<string,string>")


def _svm_specs(keys: list[tuple], width: int, variance: float, fold: int | None) -> list[svm.Spec]:
    return [svm.Spec(c, None if kernel == "linear" else svm.gamma_value(gamma, width, variance), fold)
            for kernel, c, gamma in keys]


def _entry_variance_without(df: DataFrame, fold: str) -> tuple[int, dict[int, float]]:
    """Variance of all matrix entries of the rows outside each fold; one aggregate."""
    stats = {r[fold]: (float(r["n"]), np.asarray(r["mean"]), np.asarray(r["var"]))
             for r in bounded_rows(moments(df, [fold]))}
    out, width = {}, 0
    for f in stats:
        n, mean, var = bayes._merge([v for g, v in stats.items() if g != f])
        out[f] = float(np.mean(var + mean**2) - np.mean(mean) ** 2)
        width = len(mean)
    return width, out


def _tree_scores(train: DataFrame, valid: DataFrame, keys: list[tuple], folds: list, fold: str | None) -> dict:
    """(setting, fold) -> recall. Settings that differ in depth only share one tree."""
    rules = list(dict.fromkeys(k[:3] for k in keys))
    depths = list(dict.fromkeys(k[3] for k in keys))
    deepest = None if None in depths else max(depths)
    specs = [trees.TreeSpec(*r, f, deepest) for f in folds for r in rules]
    scores = trees.grid_recalls(train, valid, specs, depths, fold=fold)
    return {((*r, d), f): by[d] for (f, r), by in zip(product(folds, rules), scores) for d in depths}


def _recalls(train: DataFrame, valid: DataFrame, model: str, keys: list[tuple]) -> list[float]:
    """Recall on ``valid`` of every distinct setting trained on ``train``."""
    if model == "decision_tree":
        scores = _tree_scores(train, valid, keys, [None], None)
        return [scores[k, None] for k in keys]
    if model == "svm":
        specs = _svm_specs(keys, *svm.entry_variance(train), None)
        fitted = svm.fit_svms(train, specs, size=models.SVM_FEATURES)
        return svm.recalls(valid, fitted, size=models.SVM_FEATURES)
    both = train.select("label", "features", F.lit(1).alias("fold")).unionByName(
        valid.select("label", "features", F.lit(0).alias("fold")))
    scores = bounded_rows(bayes.grid_search(both, [k[0] for k in keys]).where("fold = 0"))
    by_index = {r["grid_index"]: r["cv_score"] for r in scores}
    return [by_index.get(i, 0.0) for i in range(len(keys))]


def prepared_folds(df: DataFrame, fold: str, prepare: Prepare) -> Callable[[int], tuple[DataFrame, DataFrame]]:
    """(train, validation) of a fold, resampled and scaled once and then shared by all models."""
    ready: dict[int, tuple[DataFrame, DataFrame]] = {}

    def get(f: int) -> tuple[DataFrame, DataFrame]:
        if f not in ready:
            ready[f] = prepare(df.where(F.col(fold) != f).drop(fold), df.where(F.col(fold) == f).drop(fold))
        return ready[f]

    return get


def fold_scores(df: DataFrame, model: str, fold: str = "fold", prepared: Callable | None = None,
                grid: dict | None = None) -> list[tuple[int, int, float]]:
    """(grid index, fold, recall) for the whole grid."""
    combos = combinations(model, grid)
    keys = list(dict.fromkeys(effective(model, p) for p in combos))
    folds = sorted(r[0] for r in bounded_rows(df.select(fold).distinct()))
    found: dict[tuple, float] = {}
    if prepared is None and model == "svm":
        width, variances = _entry_variance_without(df, fold)
        specs = [s for f in folds for s in _svm_specs(keys, width, variances[f], f)]
        fitted = svm.fit_svms(df, specs, fold=fold, size=models.SVM_FEATURES)
        values = svm.recalls(df, fitted, fold=fold, size=models.SVM_FEATURES)
        found = {(k, f): v for (f, k), v in zip(product(folds, keys), values)}
    elif prepared is None and model == "naive_bayes_gaussian":
        for r in bounded_rows(bayes.grid_search(df, [k[0] for k in keys], fold)):
            found[keys[r["grid_index"]], r[fold]] = r["cv_score"]
    elif prepared is None:
        found = _tree_scores(df, df, keys, folds, fold)
    else:
        for f in folds:
            train, valid = prepared(f)
            for k, v in zip(keys, _recalls(train, valid, model, keys)):
                found[k, f] = v
    lost = [(k, f) for k in keys for f in folds if found.get((k, f)) is None]
    if lost:  # a missing score is no recall of 0
        raise ValueError(f"{model}: no score for {lost[0][0]} in fold {lost[0][1]}, {len(lost)} in all")
    return [(i, f, float(found[effective(model, p), f])) for i, p in enumerate(combos) for f in folds]


def scores_frame(spark, scores: list[tuple[int, int, float]]) -> DataFrame:
    return local_frame(spark, scores, "grid_index int, fold int, cv_score double")


def best_of(scores: list[tuple[int, int, float]]) -> tuple[int, float]:
    """Best mean fold score; the first combination of the grid wins ties."""
    by: dict[int, list[float]] = {}
    for i, _, v in scores:
        by.setdefault(i, []).append(v)
    means = {i: sum(v) / len(v) for i, v in by.items()}
    return min(means.items(), key=lambda m: (-m[1], m[0]))


#: Typed, nullable columns for the parameters of all models.
PARAMS = "C double, gamma string, kernel string, var_smoothing double, criterion string, max_depth int, " \
         "min_samples_leaf int, min_samples_split int"
RECORD = (f"model string, best_params struct<{PARAMS.replace(' double', ':double').replace(' string', ':string').replace(' int', ':int')}>, "
          "best_cv_score double, test_metrics struct<accuracy:double,precision:double,recall:double,f1_score:double>, "
          "n_combinations_tested bigint, cv_folds bigint, total_fits bigint, time_seconds double, "
          "dataset_info struct<n_samples:bigint,n_features:bigint>, timestamp string, error string")
_PARAM_NAMES = [p.split()[0] for p in PARAMS.split(", ")]


def tune_model(df: DataFrame, model: str, test: DataFrame | None = None, fold: str = "fold",
               prepare: Prepare | None = None, grid: dict | None = None,
               prepared: Callable | None = None) -> dict:
    """One search. A failure becomes a record with its error text instead of ending the run."""
    began = time.perf_counter()
    record = {"model": model, "best_params": None, "best_cv_score": None, "test_metrics": None,
              "n_combinations_tested": 0, "cv_folds": 0, "total_fits": 0, "error": None}
    try:
        if prepare is not None and prepared is None:
            prepared = prepared_folds(df, fold, prepare)
        scores = fold_scores(df, model, fold, prepared, grid)
        at, score = best_of(scores)
        combos = combinations(model, grid)
        folds = len({f for _, f, _ in scores})
        record.update(best_params={p: combos[at].get(p) for p in _PARAM_NAMES}, best_cv_score=score,
                      n_combinations_tested=len(combos), cv_folds=folds, total_fits=len(combos) * folds)
        if test is not None:
            train, held = (df.drop(fold), test) if prepare is None else prepare(df.drop(fold), test)
            pred = models.predict(held, models.fit(train, model, combos[at]))
            row = basic_metrics(pred, [], "label").first()
            record["test_metrics"] = {"accuracy": row[0], "precision": row[1], "recall": row[2], "f1_score": row[3]}
        size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("w")).first()
        record["dataset_info"] = {"n_samples": size["n"], "n_features": size["w"]}
    except Exception as e:  # noqa: BLE001
        record["error"] = f"{type(e).__name__}: {e}"[:2000]
    record.update(time_seconds=time.perf_counter() - began, timestamp=stamp())
    record.setdefault("dataset_info", None)
    return record


def records_frame(spark, records: list[dict]) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in
             ("model", "best_params", "best_cv_score", "test_metrics", "n_combinations_tested", "cv_folds",
              "total_fits", "time_seconds", "dataset_info", "timestamp", "error")]
    return local_frame(spark, [tuple(r[n] for n in names) for r in records], RECORD)


def tune(df: DataFrame, names: list[str] | None = None, test: DataFrame | None = None, fold: str = "fold",
         prepare: Prepare | None = None, grids: dict | None = None) -> DataFrame:
    """Records of all models for one configuration."""
    prepared = prepared_folds(df, fold, prepare) if prepare is not None else None
    return records_frame(df.sparkSession, [
        tune_model(df, n, test, fold, prepare, (grids or {}).get(n), prepared)
        for n in names or models.NAMES])
