"""Stored result records: one JSON document per configuration and model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLS = "struct<precision:double,recall:double,`f1-score`:double,support:double>"
_PARAMS = ("struct<C:double,gamma:string,kernel:string,var_smoothing:double,criterion:string,"
           "max_depth:int,min_samples_leaf:int,min_samples_split:int>")
#: Layout of a stored metric record.
METRICS_SCHEMA = (
    "TP bigint, TN bigint, FP bigint, FN bigint, P bigint, N bigint, Total bigint, Error double, "
    "Exactitud double, TP_Rate double, FP_Rate double, Precision double, Recall double, Sensibilidad double, "
    "Especificidad double, F1_Score double, Accuracy_sklearn double, ROC_AUC double, PR_AUC double, "
    f"classification_report struct<`No-Buggy`:{_CLS},Buggy:{_CLS},accuracy:double,`macro avg`:{_CLS},"
    f"`weighted avg`:{_CLS}>, confusion_matrix array<array<bigint>>, training_time_seconds double, "
    f"best_hyperparameters {_PARAMS}, timestamp string")
#: Layout of a stored tuning record.
TUNING_SCHEMA = (
    f"best_params {_PARAMS}, best_cv_score double, "
    "test_metrics struct<accuracy:double,precision:double,recall:double,f1_score:double>, "
    "n_combinations_tested bigint, cv_folds bigint, total_fits bigint, time_seconds double, "
    "dataset_info struct<n_samples:bigint,n_features:bigint>, timestamp string")


def _scan(spark: SparkSession, root: str, suffix: str, schema: str) -> DataFrame:
    """<root>/<method>/<dataset>/<scaler>/<model><suffix>, keys taken from the path."""
    path = F.col("_metadata.file_path")
    part = lambda g: F.regexp_extract(
        path, r"([^/]+)/([^/]+)/([^/]+)/([^/]+)" + suffix.replace(".", r"\.") + "$", g)
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    # text that is no JSON gives no record, and neither does JSON of another shape
    record = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema))
    return whole.select(part(2).alias("dataset"), part(1).alias("balancing_method"), part(3).alias("scaler_type"),
                        part(4).alias("model"), record.alias("record"))


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """All metric records under a folder; documents that do not parse are left out."""
    df = _scan(spark, root, "_final_metrics.json", METRICS_SCHEMA).where(F.col("record").isNotNull())
    return df.select("dataset", "balancing_method", "scaler_type", "model", "record.*")


def read_tuning(spark: SparkSession, root: str) -> DataFrame:
    """All tuning records; a broken document has NULL ``best_params`` and counts as not done."""
    df = _scan(spark, root, "_best_params.json", TUNING_SCHEMA)
    return df.select("dataset", "balancing_method", "scaler_type", "model", "record.*")


def write_records(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON documents, one folder per key."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stamp() -> str:
    """ISO-8601 time of a record."""
    return dt.datetime.now().isoformat()
