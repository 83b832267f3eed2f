"""Vector columns (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    # The outer step names the norm, which would else be worked out again for every element.
    scaled = F.transform(
        F.array(norm(vector)),
        lambda length: F.transform(vector, lambda v: F.when(length > 0, v / length).otherwise(v.cast("double"))),
    )
    return scaled[0]


def cosine_distance(left: Column, right: Column) -> Column:
    return 1.0 - dot(left, right) / (norm(left) * norm(right))
