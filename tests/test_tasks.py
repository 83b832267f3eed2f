from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxlake import schemas
from voxlake.operators import lifecycle as L
from voxlake.operators import tasks as T

STEP = "task_id bigint, task_name string, task_order int, phase string, status string, attempt_count int, max_attempts int"


@pytest.fixture(scope="module")
def steps(spark):
    rows = [
        (1, "a", 0, "init", "completed", 1, 3), (1, "b", 1, "init", "skipped", 0, 3), (1, "c", 2, "init", "queued", 3, 3),
        (1, "d", 3, "init", "running", 1, 3), (1, "e", 4, "init", "failed", 1, 3), (2, "a", 0, "init", "skipped", 0, 3),
    ]
    return spark.createDataFrame(rows, STEP)


def test_progress(steps):
    rows = {r.task_id: r for r in T.workflow_progress(steps).collect()}
    assert (rows[1].total, rows[1].pending, rows[1].percent, rows[1].current_name) == (5, 1, 25.0, "c")
    assert (rows[2].percent, rows[2].current_name) == (0.0, None)


def test_next_step(steps):
    assert [(r.task_id, r.task_name) for r in T.next_step(steps).collect()] == [(1, "c")]
    assert [(r.task_id, r.task_name) for r in T.next_step(steps, True).collect()] == [(1, "e")]


def test_pages_of_steps(spark, steps):
    out = T.nest_steps(spark.createDataFrame([(1,), (3,)], "task_id bigint"), steps, page_size=2).orderBy("task_id", "page").collect()
    assert [(r.task_id, r.page, [s.task_name for s in r.steps or []]) for r in out] == [
        (1, 0, ["a", "b"]), (1, 1, ["c", "d"]), (1, 2, ["e"]), (3, 0, [])]


def test_summary_defaults(spark, steps):
    tasks = T.evolve(spark.createDataFrame([(1, ""), (9, None)], "task_id bigint, filename string"), schemas.TASKS)
    rows = {r.task_id: r for r in T.task_summary(T.enrich_tasks(tasks, steps)).collect()}
    assert rows[1].filename == "Unknown" and rows[1].status == "unknown" and rows[1].tgt_lang == "en"
    assert rows[1].current_task.name == "c" and rows[9].current_task is None and rows[9].workflow_summary.total == 0


def test_interrupted_needs_a_phase_or_the_flag(spark):
    rows = [(1, "running", None, False), (2, "running", None, True), (3, "running", "complete", False), (4, "queued", "translating", None), (5, "paused", "translating", None)]
    df = spark.createDataFrame(rows, "task_id bigint, status string, phase string, was_running_at_shutdown boolean").withColumn("updated_at", F.lit(1))
    assert sorted(r.task_id for r in T.interrupted_tasks(df).collect()) == [2, 4]


def test_phase_chain(spark):
    df = spark.createDataFrame([(1, "translating", "awaiting_validation"), (2, "recomposing", "done"), (3, None, "failed")], "task_id bigint, phase string, status string")
    rows = {(r.task_id, r.step_phase): r.state for r in T.phase_chain(df).collect()}
    assert len(rows) == 33
    assert rows[(1, "translating")] == "completed" and rows[(1, "awaiting_translation_review")] == "attention"
    assert rows[(2, "recomposing")] == "completed" and rows[(2, "complete")] == "running"
    assert rows[(3, "init")] == "failed" and rows[(3, "identifying")] == "pending"
    short = T.phase_chain(df, short=True, use_diarization=False)
    assert [r.step_no for r in short.where("task_id = 1").orderBy("step_no").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("phase,status,command,target,expected", [
    ("translating", "paused", "start", None, ("translating", "paused", True, "applied")),
    ("awaiting_translation_review", "paused", "start", None, ("awaiting_translation_review", "paused", False, "refused")),
    ("translating", "completed", "start", None, ("translating", "completed", False, "refused")),
    ("complete", "paused", "resume", None, ("complete", "completed", False, "applied")),
    ("init", "paused", "resume", None, ("init", "awaiting_validation", False, "applied")),
    ("translating", "completed", "resume", None, ("translating", "queued", True, "applied")),
    ("translating", "running", "pause", None, ("translating", "paused", False, "applied")),
    ("translating", "running", "restart", None, ("init", "awaiting_validation", False, "applied")),
    ("translating", "running", "restart", "synthesizing", ("synthesizing", "queued", True, "applied")),
    ("translating", "running", "restart", "complete", ("translating", "running", False, "refused")),
    ("awaiting_audio_validation", "awaiting_validation", "confirm_audio", None, ("recomposing", "queued", True, "applied")),
])
def test_commands(spark, phase, status, command, target, expected):
    tasks = spark.createDataFrame([(1, phase, status, False, 40.0)], "task_id bigint, phase string, status string, was_running_at_shutdown boolean, progress double")
    commands = spark.createDataFrame([(1, 2, command, target)], "task_id bigint, seq int, command string, from_phase string")
    row = L.apply_commands(tasks, commands).first()
    assert (row.phase, row.status, row.was_running_at_shutdown, row.command_note) == expected


LOG = "task_id bigint, seq int, command string, from_phase string"
TASK = "task_id bigint, phase string, status string, was_running_at_shutdown boolean, progress double"


@pytest.mark.parametrize("limit", [0, 3])
@pytest.mark.parametrize("commands,expected,notes", [
    ([("confirm_speakers", None), ("pause", None)], ("transcribing", "paused", False), ["applied", "applied"]),
    ([("restart", "translating"), ("start", None)], ("translating", "queued", True), ["applied", "applied"]),
    ([("start", None), ("confirm_speakers", None), ("start", None)], ("transcribing", "queued", True), ["refused", "applied", "applied"]),
    ([("pause", None), ("resume", None)], ("awaiting_speaker_validation", "awaiting_validation", False), ["applied", "applied"]),
    ([("restart", None), ("start", None), ("confirm_audio", None), ("resume", None)], ("recomposing", "queued", True), ["applied", "refused", "applied", "applied"]),
    ([("cancel", None), ("restart", "nowhere"), (None, None)], ("awaiting_speaker_validation", "cancelled", False), ["applied", "refused", "applied"]),
])
def test_commands_follow_each_other(spark, chunked, limit, commands, expected, notes):
    tasks = spark.createDataFrame([(1, "awaiting_speaker_validation", "awaiting_validation", False, 40.0), (2, None, None, None, 1.0)], TASK)
    log = spark.createDataFrame([(1, i, *c) for i, c in enumerate(commands)] + [(9, 1, "pause", None)], LOG)
    with chunked(limit):
        row = {r.task_id: r for r in L.apply_commands(tasks, log).collect()}
        said = [r.command_note for r in L.replay_commands(tasks, log).orderBy("seq").collect()]
    assert (row[1].phase, row[1].status, row[1].was_running_at_shutdown) == expected and said == notes and row[1].command_note == notes[-1]
    assert (row[2].phase, row[2].status, row[2].command_note) == (None, None, None)


def test_a_long_log_on_cut_chunks(spark, chunked):
    import random

    rng = random.Random(2)
    names = ["start", "pause", "resume", "cancel", "restart", "confirm_speakers", "confirm_transcription", "confirm_translation", "confirm_audio"]
    log = spark.createDataFrame([(1, i, rng.choice(names), rng.choice([None, "translating", "nowhere"])) for i in range(400)], LOG)
    tasks = spark.createDataFrame([(1, "init", "pending", False, 0.0)], TASK)
    rows = lambda: [tuple(r) for r in L.replay_commands(tasks, log).select("seq", "phase_before", "status_before", "command_note").orderBy("seq").collect()]
    with chunked(0):
        plain = rows()
    with chunked(9):
        assert rows() == plain and len(plain) == 400


def test_a_log_is_shuffled_and_sorted_once(spark, chunked):
    log = spark.createDataFrame([(1, 1, "pause", None)], LOG)
    tasks = spark.createDataFrame([(1, "init", "pending", False, 0.0)], TASK)
    with chunked(0):
        plan = L.replay_commands(tasks, log)._jdf.queryExecution().optimizedPlan().toString()
        physical = L.replay_commands(tasks, log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
    assert physical.count("hashpartitioning(task_id") <= 2 and physical.count("Sort [task_id") <= 3


def test_both_names_of_the_language_in_one_update(spark):
    tasks = spark.createDataFrame([(1, "a")], "task_id bigint, tgt_lang string")
    updates = spark.createDataFrame([(1, 1, {"tgt_lang": "fr", "target_language": "de"})], "task_id bigint, seq int, fields map<string,string>")
    assert L.update_tasks(tasks, updates).first().tgt_lang == "de"


def test_step_updates(spark, steps):
    base = steps.withColumns({"started_at": F.lit(None).cast("timestamp"), "error_message": F.lit("old")})
    at = [datetime(2024, 1, d) for d in (1, 2, 3)]
    log = spark.createDataFrame(
        [(1, "c", 1, at[0], "running", None), (1, "c", 2, at[1], "running", "bad"), (1, "c", 3, at[2], None, None)],
        "task_id bigint, task_name string, seq int, at timestamp, status string, error_message string")
    log = log.withColumns({"output_data": F.lit(None).cast("string"), "checkpoint_data": F.lit(None).cast("string")})
    rows = {r.task_name: r for r in L.apply_step_updates(base, log).where("task_id = 1").collect()}
    assert (rows["c"].status, rows["c"].attempt_count, rows["c"].started_at, rows["c"].error_message) == ("running", 5, at[1], "bad")
    assert (rows["a"].status, rows["a"].error_message) == ("completed", "old")


def test_update_tasks(spark):
    tasks = spark.createDataFrame([(1, "a", False, {"k": "1"}), (2, "b", True, None)], "task_id bigint, tgt_lang string, separate_audio boolean, data map<string,string>")
    updates = spark.createDataFrame([(1, 1, {"target_language": "de", "x": "1"}), (1, 2, {"separate_audio": "YES", "x": "2", "k": None})], "task_id bigint, seq int, fields map<string,string>")
    rows = {r.task_id: r for r in L.update_tasks(tasks, updates).collect()}
    assert (rows[1].tgt_lang, rows[1].separate_audio, rows[1].data) == ("de", True, {"k": None, "x": "2"})
    assert (rows[2].tgt_lang, rows[2].separate_audio, rows[2].data) == ("b", True, None)


def test_phase_percent(spark):
    df = spark.createDataFrame([("translating", 1, 3), ("identifying", 0, 0), ("init", 1, 1), ("recomposing", 4, 4)], "phase string, current int, total int")
    assert [r.overall_percent for r in T.phase_percent(df).collect()] == [50, 20, None, 92]


def test_dashboard_only_reads_the_recent(spark):
    from voxlake.catalog.bindings import Tables
    from voxlake.plans.dashboard import dashboard

    t = Tables(spark, "/root/testdata/sf0.001")
    assert dashboard(t.tasks, t.steps, 5).count() == 5
