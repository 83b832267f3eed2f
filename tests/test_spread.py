"""Work on large tables is dealt by their rows, so that what a task holds does not grow with them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxlake.catalog.bindings import Tables
from voxlake.catalog.registry import QUERIES
from voxlake.operators import scoring as C
from voxlake.operators import speakers as P
from voxlake.operators import tasks as T
from voxlake.plans.spread import TASK_CONF, spread_even

FOLDER = "/root/testdata/sf0.001"  # 6,000 lines, 1,000 events, 150 customers


@pytest.fixture
def task_rows(spark):
    """Tasks for 100 rows each; AQE would join such small ones again."""
    spark.conf.set(TASK_CONF, "100")
    yield 100
    spark.conf.unset(TASK_CONF)


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_steps_and_their_progress_are_made_by_as_many_tasks_as_lines_need(spark, task_rows):
    steps = Tables(spark, FOLDER).steps
    for out in (steps, T.workflow_progress(steps)):
        assert out.rdd.getNumPartitions() == 60 and max(sizes(out)) <= 300
    plan = T.workflow_progress(steps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_larger_dashboard_has_more_buckets_each_written_by_one_task(spark, folder, monkeypatch):
    from voxlake.catalog import live
    from voxlake.streaming.refresh import LiveDashboard

    monkeypatch.setattr(live, "scratch", lambda t, name: f"{folder}/{name}")
    spark.conf.set(TASK_CONF, "300")
    try:
        rows = QUERIES["i09_dashboard_refresh"](spark, FOLDER)
    finally:
        spark.conf.unset(TASK_CONF)
    board = LiveDashboard.at(spark, f"{folder}/board")
    for table in (board.tasks, board.steps, board.rows):
        found = table.head().folders
        files = [len(list(Path(table.path, f).glob("*.parquet"))) for f in found.values()]
        assert len(found) == 20 and set(files) == {1}
        tasks = table.read().withColumn("file", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).groupBy("file")
        assert max(r.n for r in tasks.agg(F.count_distinct(F.pmod(F.xxhash64("task_id"), F.lit(20))).alias("n")).collect()) == 1
    assert rows.count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()


def test_segments_meet_their_speakers_in_as_many_tasks_as_they_need(spark, task_rows):
    t = Tables(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert P.resolve_speakers(t.speakers).rdd.getNumPartitions() == 8  # 600 of them, on 8 cores
        segments = P.voice_sample(t.segments, t.speakers)
        assert segments.rdd.getNumPartitions() == 10 and segments.count() == 1000
        spark.conf.set("spark.voxlake.chunkRows", "2")  # a speaker with more segments is left to adaptive execution
        assert "REPARTITION_BY_NUM" not in spread_even(t.segments, P.SPEAKER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.voxlake.chunkRows")


def test_transcripts_are_dealt_by_their_text(spark):
    rows = [(k, i, f"word{k}-{i} " * 5) for k in range(40) for i in range(3)]
    df = spark.createDataFrame(rows, "task_id bigint, idx int, original_text string")
    chars = sum(len(r[2]) for r in rows)
    out = C.analyze(df, "summary", lambda: lambda prompt: prompt.split("TEXT:\n")[1], task_chars=chars // 20)
    assert out.rdd.getNumPartitions() in (20, 21)
    assert {r.task_id: r.analysis for r in out.collect()} == {k: " ".join(f"word{k}-{i} " * 5 for i in range(3)).strip() for k in range(40)}
    none = C.analyze(df.where("false"), "summary", lambda: lambda prompt: prompt)
    assert none.count() == 0
