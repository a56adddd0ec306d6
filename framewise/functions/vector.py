"""Column functions on embeddings (arrays of float); sums run in double.

Lambdas over arrays are interpreted; for whole tables against many vectors use the matrix product of
:func:`framewise.operators.retrieval.similarities`, which is several times faster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def cosine(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Cosine similarity; null for a zero vector unless ``floor`` bounds the norms from below."""
    if floor:
        return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def usable(a: Column, dim: int = 64) -> Column:
    """Not null, of the right length, without null and NaN."""
    return (F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x))
