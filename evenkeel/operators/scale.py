"""Standard and robust feature scaling: statistics from train rows, applied anywhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.numeric import double_array
from evenkeel.operators.quantiles import TASK_ROWS, exact_quantiles
from evenkeel.operators.small import local_frame


@dataclass(frozen=True)
class Scaler:
    """(x - center) / scale per feature. Width-sized, so it travels as literals."""

    kind: str
    center: tuple[float, ...]
    scale: tuple[float, ...]

    def to_frame(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        names = names or [f"f{i}" for i in range(len(self.center))]
        return local_frame(
            spark, list(zip(names, self.center, self.scale)), "feature string, center double, scale double")

    def apply_columns(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """Plain column arithmetic: stays inside whole-stage codegen."""
        scaled = {c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                  for c, m, s in zip(cols, self.center, self.scale)}
        return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])

    def apply_vector(self, df: DataFrame, features: str = "features") -> DataFrame:
        shifted = F.zip_with(features, double_array(self.center), lambda x, m: x - m)
        return df.withColumn(features, F.zip_with(shifted, double_array(self.scale), lambda x, s: x / s))


def _divisors(values) -> tuple[float, ...]:
    return tuple(1.0 if v == 0 else float(v) for v in values)


def moments(df: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """n, mean and population variance per feature and group: one partial aggregate, any width."""
    stats = df.select(*by, array_to_vector(features).alias("_v")).groupBy(*by).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("_s"))
    n = F.col("_s.count")
    return stats.select(
        *by, n.alias("n"), vector_to_array("_s.mean").alias("mean"),
        F.transform(vector_to_array("_s.variance"),
                    lambda v: v * (F.greatest(n, F.lit(1)) - 1) / F.greatest(n, F.lit(1))).alias("var"),
    )


def fit_standard(df: DataFrame, cols: list[str]) -> Scaler:
    """Mean and population deviation; a constant column divides by 1."""
    row = df.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    d = len(cols)
    return Scaler("standard", tuple(float(v) for v in row[:d]), _divisors(row[d:]))


def fit_standard_vector(df: DataFrame, features: str = "features") -> Scaler:
    row = moments(df, [], features).first()
    return Scaler("standard", tuple(row["mean"]), _divisors(v ** 0.5 for v in row["var"]))


def fit_robust(df: DataFrame, cols: list[str], task_rows: int = TASK_ROWS) -> Scaler:
    """Median and inter-quartile range, exact; a zero range divides by 1."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], task_rows)
    return Scaler("robust", tuple(v[1] for v in q), _divisors(v[2] - v[0] for v in q))


def unpack(df: DataFrame, width: int, features: str = "features") -> DataFrame:
    return df.selectExpr(*[f"get({features}, {i}) AS f{i}" for i in range(width)])


def vector_width(df: DataFrame, features: str = "features") -> int:
    return df.select(F.size(features)).first()[0]


def fit_robust_vector(df: DataFrame, features: str = "features", task_rows: int = TASK_ROWS) -> Scaler:
    wide = unpack(df, vector_width(df, features), features)
    return fit_robust(wide, wide.columns, task_rows)


def fit_scaler(df: DataFrame, kind: str, features: str = "features") -> Scaler:
    if kind == "standard":
        return fit_standard_vector(df, features)
    if kind == "robust":
        return fit_robust_vector(df, features)
    raise ValueError(f"unknown scaler: {kind}")
