"""Small numeric rules for sampled signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def sample_at(seconds: Column, rate: Column | int) -> Column:
    """Sample position of a time, truncated toward zero."""
    return (seconds * rate).cast("bigint")


def soft_clip(value: Column, drive: float = 0.8) -> Column:
    return F.tanh(value * drive) / drive


def ceil_div(value: Column, size: int) -> Column:
    return F.ceil(value / size).cast("bigint")
