"""Live views of progress and logs, and sinks that survive retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxlake.operators.segments import log_tail
from voxlake.plans.ordered import Ordered

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def latest_progress(stream: DataFrame) -> DataFrame:
    """The last progress message of each project (update mode).  Partial results combine before the shuffle."""
    newest = F.max_by(F.struct("phase", "percent", "message"), "ts")
    return stream.groupBy("task_id").agg(F.max("ts").alias("ts"), newest.alias("m")).select("task_id", "ts", "m.*")


def stream_sessions(stream: DataFrame, gap: str = "1 second", watermark: str = "10 seconds", key: str = "task_id") -> DataFrame:
    """Activity sessions: rows closer than ``gap``; a session is final when the watermark has passed it.

    With LOCAL_MERGE on, rows of one session meet before the shuffle.
    """
    rows = stream.withWatermark("ts", watermark) if watermark else stream
    return (
        rows.groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("rows"), F.max("ts").alias("last_ts"))
        .select(key, F.col("w.start").alias("start_ts"), "last_ts", "rows")
    )


def sessions(rows: DataFrame, gap_seconds: float, key: str = "task_id") -> DataFrame:
    """The sessions of a finished table; a key with very many rows is cut, which a session window would not do."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ordered = Ordered.of(rows.select(key, "ts"), [key], ["ts"], at).previous("__prev", at)
    fresh = F.col("__prev").isNull() | (at - F.col("__prev") >= int(gap_seconds * 1_000_000))
    ordered = ordered.with_column("__new", F.when(fresh, 1).otherwise(0)).running_sum("__session", F.col("__new"))
    return (
        ordered.done()
        .groupBy(key, "__session")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("rows"))
        .drop("__session")
    )


def stream_windows(
    stream: DataFrame, length: str = "30 seconds", slide: str | None = None, watermark: str = "10 seconds", key: str = "task_id"
) -> DataFrame:
    """Counts and mean percent per fixed or sliding window."""
    rows = stream.withWatermark("ts", watermark) if watermark else stream
    return (
        rows.groupBy(key, F.window("ts", length, slide).alias("w"))
        .agg(F.count("*").alias("rows"), F.avg("percent").alias("percent"))
        .select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "rows", "percent")
    )


class _Tail(StatefulProcessor):
    """Keeps the last n entries of one project in list state."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "seq bigint, message string, style string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.entries.get()]
        for batch in rows:
            kept += list(batch[["seq", "message", "style"]].itertuples(index=False, name=None))
            kept = sorted(kept)[-self.n :]
        self.entries.put([(int(s), m, t) for s, m, t in kept])
        yield pd.DataFrame({
            "task_id": [key[0]] * len(kept),
            "seq": [r[0] for r in kept], "message": [r[1] for r in kept], "style": [r[2] for r in kept],
        })

    def close(self) -> None:
        pass


def stream_log_tail(stream: DataFrame, n: int = 100) -> DataFrame:
    """The last n log entries of each project that had news in the batch (update mode, RocksDB state).

    Entries that n newer ones of their Arrow batch displace are dropped before the shuffle, so a
    project with very many entries sends few of them to its task.
    """

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values("seq").groupby("task_id", sort=False).tail(n)

    entries = stream.select("task_id", "seq", "message", "style")
    return entries.mapInPandas(thin, entries.schema).groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=_Tail(n),
        outputStructType="task_id bigint, seq bigint, message string, style string",
        outputMode="Update",
        timeMode="None",
    )


def append_changes(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch to its own folder.

    Writing a batch again replaces its folder, so a retried batch is not counted twice, and the
    work of a batch grows with its changes and not with the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def read_current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key written by ``append_changes``."""
    changes = spark.read.parquet(path)
    fields = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*keys, "r.*")


def read_newest_groups(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """All rows of each key's newest batch, for sinks that write a key's whole list at once."""
    changes = spark.read.parquet(path)
    newest = changes.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return changes.join(newest, [*keys, "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """Write the current rows as batch -1 of a new folder, where later batches can follow."""
    read_current(spark, path, keys).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch=-1")


def start_refresh(stream: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", once: bool = False):
    """Keep the latest progress of all projects in a table that is brought up to date on a timer."""
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        latest_progress(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(append_changes(path))
        .trigger(**trigger)
        .start()
    )
