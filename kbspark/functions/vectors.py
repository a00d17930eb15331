"""Vector functions over array columns, in double precision and in the order of the components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import round_half_up


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def score(similarity: Column) -> Column:
    """What a hit shows: the similarity to two places."""
    return round_half_up(similarity, 2)
