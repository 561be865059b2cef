"""Vector columns: text encoding and cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_vector(vector: Column) -> Column:
    """Text literal ``[1.0,2.0]``."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]")
    )


def decode_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")
        )
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when a vector is missing or all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)
