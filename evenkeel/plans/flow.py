"""From raw rows to one metric table: split, balance, scale, tune, fit, predict, evaluate.

``order="leak_free"`` (default) resamples and scales inside each fold; ``order="reference"``
does both once before the folds are cut, so synthetic rows can leak into validation rows.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import balance as B
from evenkeel.operators import metrics, models, prep, rank, report, scale, tuning
from evenkeel.operators.small import bounded_rows, cut_lineage, local_frame

#: The stored target name and the columns that never serve as predictors.
TARGET = "RealBug"
DROP = ["HeuBug", "HeuBugCount", "RealBugCount"]


def preprocess(raw: DataFrame, target: str = TARGET, drop: list[str] = DROP, id_col: str = "row_id",
               dataset: str = "dataset", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Working rows: dataset, row_id, label, features, split.

    Rows need an id; the split is exact per dataset and class without moving rows.
    """
    df = prep.cast_target(prep.drop_if_present(raw, drop), target)
    cols = prep.numeric_columns(df, exclude=(id_col, "label"))
    df = prep.assemble(df, cols).select(dataset, id_col, "label", "features")
    return rank.stratified_split(df, "label", id_col, test_share, seed, [dataset])


def balanced(train: DataFrame, method: str, **options) -> DataFrame:
    return B.balance(train, method, **options)


def scaled(train: DataFrame, test: DataFrame, scaler: str) -> tuple[DataFrame, DataFrame]:
    """Both sides scaled with statistics of ``train`` alone."""
    fitted = scale.fit_scaler(train, scaler)
    return fitted.apply_vector(train), fitted.apply_vector(test)


def preparer(method: str, scaler: str, **options) -> tuning.Prepare:
    """Resampling and scaling of one fold: training rows only decide, validation rows stay original."""
    def prepare(train: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = cut_lineage(balanced(train, method, **options))
        return scaled(rows, valid, scaler)

    return prepare


def tune_configuration(train: DataFrame, test: DataFrame | None, method: str, scaler: str,
                       order: str = "leak_free", names: list[str] | None = None, folds: int = 3,
                       grids: dict | None = None, **options) -> DataFrame:
    """Tuning records of one configuration, keys attached."""
    if order == "leak_free":
        rows = cut_lineage(rank.stratified_folds(train, "label", "row_id", folds))
        records = tuning.tune(rows, names, test, "fold", preparer(method, scaler, **options), grids)
    elif order == "reference":
        rows = cut_lineage(balanced(train, method, **options))
        rows, held = scaled(rows, train.limit(0) if test is None else test, scaler)
        rows = cut_lineage(rank.stratified_folds(rows, "label", ["row_id", "copy"], folds))
        records = tuning.tune(rows, names, None if test is None else held, "fold", None, grids)
    else:
        raise ValueError(f"unknown order: {order}")
    return records.withColumns({"balancing_method": F.lit(method), "scaler_type": F.lit(scaler)})


def fit_and_predict(train: DataFrame, test: DataFrame, name: str, params: dict, keys: dict,
                    save_to: str | None = None) -> tuple[DataFrame, float]:
    """Test predictions of one model fitted on all training rows, and the seconds the fit took."""
    began = time.perf_counter()
    model = models.fit(train, name, params)
    took = time.perf_counter() - began
    if save_to:
        models.save(train.sparkSession, model, save_to)
    pred = models.predict(test, model).select(
        *[F.lit(v).alias(k) for k, v in keys.items()], F.lit(name).alias("model"), "row_id",
        F.col("label").alias("y_true"), "y_pred", "score")
    return pred, took


def run(rows: DataFrame, methods=tuple(report.METHODS), scalers=tuple(report.SCALERS), names=tuple(models.NAMES),
        order: str = "leak_free", folds: int = 3, grids: dict | None = None, done: DataFrame | None = None,
        model_dir: str | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All datasets x methods x scalers x models. Returns (metrics, predictions, tuning records).

    ``done``: earlier records with their keys; usable ones are reused instead of searched again.
    Every configuration is evaluated in one grouped job over all predictions. One whose search
    failed keeps its row of the metrics, which are null.
    """
    spark = rows.sparkSession
    known = {}
    if done is not None:
        for r in bounded_rows(done.where(F.col("best_params").isNotNull())):
            known[r["dataset"], r["balancing_method"], r["scaler_type"], r["model"]] = r
    preds, records, fits, failed = [], [], [], []
    for (dataset,) in sorted(bounded_rows(rows.select("dataset").distinct())):
        part = rows.where(F.col("dataset") == F.lit(dataset)).drop("dataset")
        train, test = part.where("split = 'train'").drop("split"), part.where("split = 'test'").drop("split")
        for method in methods:
            fitted_on = cut_lineage(balanced(train, method, **options.get(method, {})))
            for scaler in scalers:
                keys = {"dataset": dataset, "balancing_method": method, "scaler_type": scaler}
                new = [n for n in names if (*keys.values(), n) not in known]
                if new:
                    found = tune_configuration(train, None, method, scaler, order, new, folds, grids,
                                               **options.get(method, {})).withColumn("dataset", F.lit(dataset))
                    records.append(found)
                    known.update({(*keys.values(), r["model"]): r for r in found.collect()})
                train_s, test_s = scaled(fitted_on, test, scaler)
                for n in names:
                    best = known[(*keys.values(), n)]["best_params"]
                    if best is None:
                        failed.append((*keys.values(), n))
                        continue
                    path = f"{model_dir}/{method}/{dataset}/{scaler}/{n}" if model_dir else None
                    pred, took = fit_and_predict(train_s, test_s, n, best.asDict(), keys, path)
                    preds.append(pred)
                    fits.append((*keys.values(), n, took))
    if not preds:
        raise ValueError(f"no configuration could be fitted: {failed[:3]}, {len(failed)} in all")
    predictions = cut_lineage(reduce(DataFrame.unionByName, preds))
    table = metrics.evaluate(predictions, report.KEYS)
    timing = local_frame(spark, fits, "dataset string, balancing_method string, scaler_type string, model string, "
                                      "training_time_seconds double")
    table = report.stored_names(table.join(F.broadcast(timing), report.KEYS))
    lost = local_frame(spark, failed, "dataset string, balancing_method string, scaler_type string, model string")
    table = table.unionByName(lost, allowMissingColumns=True)
    tuned = reduce(DataFrame.unionByName, records) if records else None
    return table, predictions, tuned
