"""Scalar and vector column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN sorts above every number in Spark, so comparisons need it as NULL."""
    return F.when(~F.isnan(c), c)


def try_double(c: Column | str) -> Column:
    """Numeric coercion: text that is no number, and NaN, become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return nan_to_null(c.try_cast("double"))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def half_even(c: Column) -> Column:
    """Round half to even: 2.5 -> 2, 3.5 -> 4."""
    return F.rint(c).cast("long")


def half_even_to(c: Column, digits: int) -> Column:
    """Half-even rounding of the binary value: 69.195, stored just below the tie, gives 69.19."""
    unit = F.lit(10.0**digits)
    return F.rint(c * unit) / unit


def squared_distance(a: Column | str, b: Column | str) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def lerp(a: Column | str, b: Column | str, t: Column) -> Column:
    """Point at share ``t`` of the segment from vector a to vector b."""
    return F.zip_with(a, b, lambda x, y: x + t * (y - x))


def double_array(values) -> Column:
    """Constant ARRAY<DOUBLE>, handed over as one expression instead of one literal per value."""
    def text(v: float) -> str:
        v = float(v)
        return f"{v!r}D" if v == v and abs(v) != float("inf") else f"double('{v}')"

    return F.expr("array(" + ", ".join(text(v) for v in values) + ")")
