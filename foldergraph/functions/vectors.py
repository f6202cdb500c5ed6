"""Columns of dense vectors, array<float>; sums are made in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 3.4028234663852886e38


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def dense_cosine(a: Column, b: Column) -> Column:
    """0 for unlike lengths, empty vectors and vectors of length 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norms == 0), 0.0).otherwise(_dot(a, b) / norms)


def dense_distance(a: Column, b: Column) -> Column:
    """Euclidean; the largest float for unlike lengths and empty vectors."""
    apart = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), FAR).otherwise(F.sqrt(_sum(apart)))


def normalized(a: Column) -> Column:
    norm = F.sqrt(_dot(a, a))
    return F.when(norm == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm))
