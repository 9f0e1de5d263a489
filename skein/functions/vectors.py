"""Distances of array columns, inside the JVM (DI1, DI3, DI4) and bfloat16 truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(ZERO), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(ZERO), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm).otherwise(F.lit(1.0))


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS = {"euclidean": euclidean, "cosine": cosine_distance, "dot": negative_dot}


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def scale(a: Column, c: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(c))


def bfloat16(a: Column) -> Column:
    """The vector cut to bfloat16 by dropping the lower half of each float's bits, which rounds towards zero."""

    def cut(x: Column) -> Column:
        size = F.floor(F.log2(F.abs(x.cast("double"))))
        unit = F.pow(F.lit(2.0), F.greatest(size, F.lit(-126)) - 7)
        return F.when(x == 0, x).otherwise((F.signum(x) * F.floor(F.abs(x.cast("double")) / unit) * unit).cast("float"))

    return F.transform(a, cut)
