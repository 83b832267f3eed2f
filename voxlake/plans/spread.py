"""Rows dealt to as many tasks as they need.

Adaptive execution sizes the tasks of a shuffle by its compressed bytes, and by the cores where there is little, so what a
task holds in memory grows with the table for long, the more the better its rows compress.  ``spread`` deals by
rows: twice the table makes twice the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.plans.ordered import chunk_rows

TASK_CONF = "spark.voxlake.taskRows"
TASK_ROWS = 1 << 17


def tasks_for(df: DataFrame, rows: int, most: int | None = None) -> int:
    """The number of tasks for so many rows, ``most`` in each; at least one a core."""
    spark = df.sparkSession
    if most is None:
        most = int(spark.conf.get(TASK_CONF, str(TASK_ROWS)))
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def spread(df: DataFrame, keys: list[str], rows: int | None = None, most: int | None = None) -> DataFrame:
    """``df`` by its keys in ``tasks_for`` its rows, which are counted unless given.  Aggregates and joins by the same
    keys need no other shuffle.  ``rows`` and ``most`` may count something else, such as characters."""
    if df.isStreaming:
        return df
    return df.repartition(tasks_for(df, df.count() if rows is None else rows, most), *keys)


def spread_even(df: DataFrame, keys: list[str]) -> DataFrame:
    """``spread`` for a join, where no key has more rows than one task should take; else ``df`` as it is, as adaptive
    execution splits such keys, but only in shuffles of its own."""
    if df.isStreaming:
        return df
    sized = df.groupBy(*keys).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    limit = chunk_rows(df)
    if sized.rows is None or (limit > 0 and sized.most > limit):
        return df
    return spread(df, keys, sized.rows)
