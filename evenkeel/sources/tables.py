"""Typed scans and sinks: CSV, Parquet and JSON, laid out by key partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.rank import row_ids

KEYS = ["method", "dataset", "scaler", "split"]


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Give a schema in production; inference costs a second scan."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_dataset(spark: SparkSession, path: str, dataset: str, schema: str | None = None,
                 row_id: str | None = None) -> DataFrame:
    """One named CSV as rows of the multi-dataset table.

    ``row_id`` names a column of ids made from the rows' content: the same for any split of the file.
    """
    rows = read_csv(spark, path, schema)
    return (row_ids(rows, row_id) if row_id else rows).withColumn("dataset", F.lit(dataset))


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_phase(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, one folder per key; re-running one key replaces only its folder."""
    by = [c for c in (by or KEYS) if c in df.columns]
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_phase(spark: SparkSession, path: str, **keys) -> DataFrame:
    """Rows of a phase; key filters prune folders before anything is read."""
    df = spark.read.parquet(path)
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def train_test(spark: SparkSession, path: str, **keys) -> tuple[DataFrame, DataFrame]:
    df = read_phase(spark, path, **keys)
    return df.where(F.col("split") == "train"), df.where(F.col("split") == "test")


def write_predictions(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """y_true, y_pred and, where the model has one, the score as y_proba."""
    cols = [F.col("y_true"), F.col("y_pred")]
    if "score" in df.columns:
        cols.append(F.col("score").alias("y_proba"))
    write_csv(df.select(*[F.col(c) for c in by or []], *cols), path, by)
