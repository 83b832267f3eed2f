"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder``; filters and column choices reach the Parquet scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
