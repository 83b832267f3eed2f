"""Upserts into versioned tables: replays, stops half way, refresh of touched projects only."""

from datetime import datetime, timedelta

import pytest

from voxlake.operators import lifecycle as L
from voxlake.streaming import refresh as R
from voxlake.streaming.versioned import VersionedTable, merge_states

STATE = "task_id bigint, seq bigint, state map<string,string>"
START = datetime(2024, 1, 1)


@pytest.fixture
def states(spark, folder):
    table = VersionedTable(spark, f"{folder}/states", ("task_id",), buckets=4)
    table.create(spark.createDataFrame([(i, {"phase": "init", "n": str(i)}) for i in range(20)], "task_id bigint, state map<string,string>"))
    return table


def batch(spark, rows, schema=STATE):
    return spark.createDataFrame(rows, schema)


def content(table, version=None):
    return {r.task_id: dict(r.state) for r in table.read(version).collect()}


def test_states_merge_key_by_key(spark, states):
    rows = [(1, 5, {"phase": "b", "x": "1"}), (1, 4, {"phase": "a", "y": "2"}), (30, 1, {"z": "3"}), (2, 1, {}), (3, 1, {"n": None}), (None, 1, {"q": "9"}), (4, 1, None)]
    assert states.upsert(batch(spark, rows), 0, merge=merge_states())
    got = content(states)
    assert got[1] == {"phase": "b", "n": "1", "x": "1", "y": "2"} and got[30] == {"z": "3"} and got[2] == {"phase": "init", "n": "2"}
    assert got[3] == {"phase": "init", "n": None} and got[4] == {"phase": "init", "n": "4"} and len(got) == 21


def test_a_batch_again_changes_nothing(spark, states):
    first, second = batch(spark, [(1, 1, {"phase": "a"})]), batch(spark, [(1, 2, {"phase": "b"})])
    assert states.upsert(first, 0, merge=merge_states()) and states.upsert(second, 1, merge=merge_states())
    before, version = content(states), states.head().version
    assert not states.upsert(first, 0, merge=merge_states()) and not states.upsert(second, 1, merge=merge_states())
    assert content(states) == before and states.head().version == version
    assert states.upsert(first, 0, "other source", merge_states())  # each source counts its own batches


def test_a_batch_stopped_before_its_commit_leaves_no_trace(spark, states, monkeypatch):
    news = batch(spark, [(i, 1, {"phase": "late"}) for i in range(10)])
    before = content(states)

    def stopped(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", stopped)
        with pytest.raises(RuntimeError):
            states.upsert(news, 0, merge=merge_states())
    assert content(states) == before
    assert states.upsert(news, 0, merge=merge_states())
    assert sum(s["phase"] == "late" for s in content(states).values()) == 10


def test_readers_keep_their_version_and_vacuum_keeps_what_is_named(spark, states):
    for i in range(3):
        states.upsert(batch(spark, [(1, i, {"phase": f"p{i}"})]), i, merge=merge_states())
    assert content(states, 0)[1]["phase"] == "init" and content(states, 2)[1]["phase"] == "p1" and content(states)[1]["phase"] == "p2"
    now, folders = content(states), len(states._names("data"))
    states.vacuum(keep=2)
    assert content(states) == now and len(states._names("data")) < folders
    assert content(states, 2)[1]["phase"] == "p1"
    with pytest.raises(ValueError):
        states.read(0)
    states.upsert(batch(spark, [(0, 9, {"phase": "after"})]), 3, merge=merge_states())
    assert content(states)[0]["phase"] == "after" and content(states)[2] == now[2]


def test_only_touched_buckets_are_written(spark, states):
    before = dict(states.head().folders)
    states.upsert(batch(spark, [(7, 1, {"phase": "x"})]), 0, merge=merge_states())
    after = dict(states.head().folders)
    assert sum(before[b] != after[b] for b in before) == 1
    states.upsert(batch(spark, []), 1, merge=merge_states())
    assert dict(states.head().folders) == after and states.head().batches["stream"] == 1


def test_rows_are_replaced_and_an_empty_table_grows(spark, folder):
    table = VersionedTable(spark, f"{folder}/rows", ("task_id", "idx"), buckets=3, by=("task_id",))
    schema = "task_id bigint, idx int, text string"
    assert table.create(batch(spark, [], schema)) and not table.create(batch(spark, [(1, 1, "again")], schema))
    assert table.read().collect() == []
    table.upsert(batch(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, None)], schema), 0)
    table.upsert(batch(spark, [(1, 1, "B"), (5, 0, "c")], schema), 1)
    assert {tuple(r) for r in table.read().collect()} == {(1, 0, "a"), (1, 1, "B"), (2, 0, None), (5, 0, "c")}
    assert {r.task_id for r in table.read(near=batch(spark, [(1,)], "task_id bigint")).collect()} >= {1}


TASKS = "task_id bigint, filename string, original_filename string, status string, phase string, progress double, created_at timestamp, updated_at timestamp, was_running_at_shutdown boolean, resume_attempts int, error_message string, src_lang string, tgt_lang string, separate_audio boolean, tts_engine string"
STEPS = "task_id bigint, task_name string, task_order int, phase string, status string, attempt_count int"


@pytest.fixture
def projects(spark):
    tasks = [(i, f"f{i}", None, "queued", "init", 0.0, START, START, False, 0, None, "fr", "es", None, None) for i in range(12)]
    steps = [(i, f"s{k}", k, "init", "pending", 0) for i in range(12) for k in range(3)]
    return spark.createDataFrame(tasks, TASKS), spark.createDataFrame(steps, STEPS)


def messages(spark, rows):
    return spark.createDataFrame([(i, START + timedelta(seconds=s), s, p, v, "m", name, status) for i, s, p, v, name, status in rows], R.ACTIVITY)


def board_rows(df):
    return sorted(map(repr, df.collect()))


BATCHES = [
    [(1, 1, "identifying", 10.0, "s0", "running"), (1, 2, None, 20.0, "s0", "completed"), (2, 1, "init", 1.0, None, None), (99, 1, "x", 5.0, "s0", "running")],
    [(1, 3, "translating", None, "s1", "running"), (3, 4, "init", 50.0, "s2", "failed"), (None, 5, "x", 1.0, None, None)],
    [(5, 9, "complete", 100.0, "s0", "skipped")],
]


def test_refresh_equals_the_whole_dashboard_and_survives_stops(spark, folder, projects, monkeypatch):
    tasks, steps = projects
    board = R.LiveDashboard.at(spark, f"{folder}/board", buckets=3)
    board.create(tasks, steps)
    computed = []
    original = R.summaries
    monkeypatch.setattr(R, "summaries", lambda t, s: computed.append({r.task_id for r in t.select("task_id").collect()}) or original(t, s))
    for i, rows in enumerate(BATCHES):
        news = messages(spark, rows)
        with monkeypatch.context() as m:  # stopped between the steps and the projects
            m.setattr(R, "live_progress", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                board.refresh(news, i)
        board.refresh(news, i)
        board.refresh(news, i)
        tasks, steps = R.live_progress(tasks, news), R.step_news(steps, news)
        assert board_rows(board.rows.read()) == board_rows(original(tasks, steps).select(*board.rows.read().columns))
    assert [c for c in computed if c] == [{1, 2}, {1, 3}, {5}]  # just the touched ones, once
    row = board.rows.read().where("task_id = 1").first()
    assert (row.phase, row.progress, row.current_task.name, row.workflow_summary.completed) == ("translating", 20.0, "s1", 1)
    assert [r.task_id for r in board.page(2).collect()] == [5, 3]
    board.create(*projects)  # a restart
    assert board.rows.read().where("task_id = 1").first() == row


def test_stream_into_the_dashboard(spark, folder, projects):
    for rows in BATCHES:
        messages(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    board = R.LiveDashboard.at(spark, f"{folder}/board", buckets=3)
    board.create(*projects)
    stream = spark.readStream.schema(R.ACTIVITY).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(2):
        R.start_dashboard(stream, board, f"{folder}/cp", once=True).awaitTermination()
    assert board.rows.head().batches == {"stream": 2}
    assert board.rows.read().where("progress > 0").count() == 4


def test_state_merge_of_tables_is_that_of_the_sink(spark, states):
    updates = batch(spark, [(3, 1, {"phase": "x"}), (50, 1, {"a": "b"})])
    want = L.merge_state(states.read(), updates.drop("seq"))
    states.upsert(updates, 0, merge=merge_states())
    assert {r.task_id: dict(r.state) for r in want.collect()} == content(states)
