from datetime import datetime, timedelta
from pathlib import Path

import pytest

from voxlake.streaming import progress as P

PROGRESS = "task_id bigint, ts timestamp, phase string, percent double, message string"
START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture
def feed(spark, folder):
    """Batches written one after the other, and a stream that takes one file at a time."""

    def build(batches, schema=PROGRESS):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    return build


def test_latest_progress_survives_a_repeated_batch(spark, folder, feed):
    stream = feed([[(1, at(1), "a", 1.0, "x"), (2, at(1), "a", 5.0, "y")], [(1, at(9), "b", 7.0, "z")]])
    P.start_refresh(stream, f"{folder}/out", f"{folder}/cp", once=True).awaitTermination()
    write = P.append_changes(f"{folder}/out")
    last = max(int(p.name.split("=")[1]) for p in Path(f"{folder}/out").glob("batch=*"))
    again = spark.read.parquet(f"{folder}/out/batch={last}").collect()
    write(spark.createDataFrame(again, "task_id bigint, ts timestamp, phase string, percent double, message string"), last)
    P.compact(spark, f"{folder}/out", f"{folder}/compact", ["task_id"])
    for path in (f"{folder}/out", f"{folder}/compact"):
        rows = {r.task_id: (r.phase, r.percent) for r in P.read_current(spark, path, ["task_id"]).collect()}
        assert rows == {1: ("b", 7.0), 2: ("a", 5.0)}


def test_sessions_close_with_the_watermark(spark, folder, feed):
    rows = [(1, at(0), "a", 1.0, ""), (1, at(2), "a", 1.0, ""), (1, at(30), "a", 1.0, ""), (2, at(100), "a", 1.0, "")]
    stream = P.stream_sessions(feed([rows]), "5 seconds", "10 seconds")
    job = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp").foreachBatch(P.append_changes(f"{folder}/out")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = {(r.task_id, r.rows) for r in spark.read.parquet(f"{folder}/out").collect()}
    batch = P.stream_sessions(spark.createDataFrame(rows, PROGRESS), "5 seconds", "").collect()
    assert got == {(1, 2), (1, 1)} and {(r.task_id, r.rows) for r in batch} == {(1, 2), (1, 1), (2, 1)}


def test_log_tail_keeps_the_newest(spark, folder, feed):
    schema = "task_id bigint, seq bigint, message string, style string"
    stream = feed([[(1, i, f"m{i}", "info") for i in range(6)], [(1, 6, "m6", "info"), (2, 1, "n", "error")]], schema)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    try:
        job = P.stream_log_tail(stream, 3).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/cp").foreachBatch(
            P.append_changes(f"{folder}/out")).trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted((r.task_id, r.seq) for r in P.read_newest_groups(spark, f"{folder}/out", ["task_id"]).collect())
    assert got == [(1, 4), (1, 5), (1, 6), (2, 1)]
