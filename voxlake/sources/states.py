"""Per-project JSON state files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake import schemas


def _read(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    options = {"multiLine": True, "mode": "PERMISSIVE", "recursiveFileLookup": True, "pathGlobFilter": pattern}
    return spark.read.schema(schemas.PROJECT_STATE).options(**options).json(path)


def read_project_states(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """The summary of every readable state file; files that are not valid JSON are left out.

    A file holds one project, or a list of them.
    """
    return _read(spark, path, pattern).where(F.col("_corrupt_record").isNull()).select(
        "task_id", "filename", "status", F.coalesce("progress", F.lit(0.0)).alias("progress"), "created_at"
    )


def read_logs(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Log entries of the state files with their place."""
    states = _read(spark, path, pattern).where(F.col("_corrupt_record").isNull())
    return states.select("task_id", F.posexplode("logs").alias("seq", "l")).select(
        "task_id", F.col("seq").cast("bigint").alias("seq"), "l.message", F.coalesce("l.style", F.lit("info")).alias("style")
    )
