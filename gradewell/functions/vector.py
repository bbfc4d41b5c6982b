"""Column builders over numeric vectors and token sets (OP-130 to 136)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero if either vector is next to nothing."""
    return F.when((norm(a) < LEAST_NORM) | (norm(b) < LEAST_NORM), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; zero if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def settled(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zeros."""
    return F.round(x, digits) + F.lit(0.0)
