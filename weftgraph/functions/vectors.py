"""Scores of vectors, larger is better: cosine, dot product, negative distance.

Elements are 32-bit floats; sums are in doubles.  A cosine with a zero vector
is 0.  A null vector has a null score.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def score(a: Column, b: Column, metric: str) -> Column:
    """The score of two vectors under ``metric``."""
    if metric == "dot":
        return dot(a, b)
    if metric == "l2":
        return -F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    size = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    cos = F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), cos)


def literal(items) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in items])
