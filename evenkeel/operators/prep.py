"""Typed preparation: column projection, target handling, checks, vector assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The narrow numeric types of the restricted projection.
RESTRICTED = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def drop_if_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def numeric_columns(df: DataFrame, restricted: bool = False, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns; ``restricted`` keeps 32/64-bit integers and floats only."""
    kinds = RESTRICTED if restricted else (T.NumericType,)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, kinds) and f.name not in exclude]


def numeric_projection(df: DataFrame, restricted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    names = set(numeric_columns(df, restricted)) | set(keep)
    return df.select(*[c for c in df.columns if c in names])


def cast_target(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """Target as INT; a NULL target stops the job instead of being imputed or dropped."""
    value = F.col(target).cast("int")
    checked = F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.lit(f"null in target column {target}")).cast("int"))
    return df.withColumn(label, checked) if label == target else df.withColumn(label, checked).drop(target)


def align(test: DataFrame, train_columns: list[str]) -> DataFrame:
    """Projects test to the train columns in train order; a missing one is an error."""
    missing = [c for c in train_columns if c not in test.columns]
    if missing:
        raise ValueError(f"test lacks train columns: {missing}")
    return test.select(*train_columns)


def assemble(df: DataFrame, cols: list[str], name: str = "features") -> DataFrame:
    """Wide numeric columns to one ARRAY<DOUBLE>."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols])).drop(
        *[c for c in cols if c != name])


def class_filter(df: DataFrame, label: str, value) -> DataFrame:
    return df.where(F.col(label) == value)


def label_codes(df: DataFrame, label: str, code: str = "label_code") -> DataFrame:
    """Alphabetical 0-based code of a label; the distinct labels are a class-level frame."""
    from pyspark.sql import Window

    from evenkeel.operators.small import same, small

    codes = df.select(label).distinct().withColumn(
        code, (F.row_number().over(Window.orderBy(F.col(label).cast("string"))) - 1).cast("int"))
    return df.alias("l").join(small(codes).alias("r"), same([label])).select("l.*", f"r.{code}")


def label_lookup(col: Column, names: dict[str, str]) -> Column:
    """Display name of a code; unknown codes stay as they are."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def join_labels(features: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Labels kept in a file of their own are joined by row id, never by position."""
    return features.join(labels, id_col)


def require_binary(sizes: DataFrame) -> None:
    n = sizes.count()
    if n != 2:
        raise ValueError(f"binary labels expected, found {n} classes")


def require_classes(sizes: DataFrame) -> None:
    if sizes.count() < 2:
        raise ValueError("at least two classes expected")
