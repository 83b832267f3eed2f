"""Shared helpers: reading tables, cutting lineage in the cluster's shared folder, document columns."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.session import checkpoint_dir
from voxlake.sources.tables import load


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below spark.checkpoint.dir and read back: lineage ends here and lost executors
    cost no recomputation."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def brief(df: DataFrame) -> DataFrame:
    """A ``saved`` table that is deleted with the last reference to this very DataFrame: hold it until all that was
    made from it has run."""
    weakref.finalize(df, _delete, df.sparkSession, df._saved_at).atexit = False
    return df


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs inside are deleted when its job has ended; else they stay on disk until the
    driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def whole(text: str | Column) -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)
