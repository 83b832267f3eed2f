import sys

import pytest
from pyspark import cloudpickle

from voxlake import constants as K
from voxlake.operators import scoring as C

# Workers cannot import the tests.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = [(1, 0, "a", None), (1, 1, "bad", None), (1, 2, "", None), (1, 3, None, "old"), (1, 4, "c", "failed")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "task_id bigint, idx int, original_text string, status string")


def flaky():
    """Fails on 'bad' always, and on every text the first time it is asked."""
    seen = set()

    def call(text):
        if text == "bad" or text not in seen:
            seen.add(text)
            raise RuntimeError("busy")
        return f" {text.upper()} "

    return call


def results(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("idx").collect()]


def test_retry_then_keep_the_input(rows):
    out = C.score(rows, flaky, pause=None)
    assert results(out, "translated_text", "status", "attempts") == [
        ("A", "translated", 2), ("bad", "translated", 3), (None, None, 0), (None, "old", 0), (None, "failed", 0)]


def test_failures_can_be_marked(rows):
    out = C.score(rows, flaky, pause=None, on_fail="error", max_retries=1)
    assert results(out, "translated_text", "status", "error")[:2] == [(None, "failed", "busy")] * 2
    with pytest.raises(ValueError):
        C.score(rows, flaky, on_fail="drop")


def test_without_a_provider_the_input_is_the_result(rows):
    assert results(C.score(rows, None), "translated_text", "status") == [
        ("a", "translated"), ("bad", "translated"), (None, None), (None, "old"), (None, "failed")]


@pytest.mark.parametrize("values,reason", [
    ([0.0] * 10, "near-silent output"), ([1.0, -1.0], None), ([20.0, 0.0], "clipped output"),
    ([float("nan"), 1.0], "non-finite output"), ([], "empty output")])
def test_quality_gate(values, reason):
    assert C.quality_gate(values) == reason


def test_waits_between_attempts():
    calls = []

    def call(text):
        calls.append(text)
        raise RuntimeError("no")

    assert C.attempt(call, "x", [0.0, 0.0]) == (None, "no", 3) and len(calls) == 3


def test_routing(spark):
    df = spark.createDataFrame(
        [(0, "t", "XTTS", "s"), (1, "t", "xtts", None), (2, "t", "bark", None), (3, "t", "who", "s"), (4, "t", None, "s"), (5, "boom", "f5", "s"), (6, "x", "f5", "s")],
        "idx int, translated_text string, engine string, voice_sample string")

    def engine(name):
        def build():
            def call(text):
                if name == "f5":
                    raise RuntimeError("Illegal instruction" if text == "boom" else "no memory")
                return f"{name}:{text}"
            return call
        return build

    out = C.route_scores(df, {n: engine(n) for n in ("xtts", "bark", "f5", "fishspeech")}, fallback={"f5": "fishspeech"})
    assert results(out, "result", "engine_used", "status") == [
        ("xtts:t", "xtts", "ok"), (None, "xtts", "error"), ("bark:t", "bark", "ok"), (None, "who", "error"),
        ("xtts:t", K.DEFAULT_ENGINE, "ok"), ("fishspeech:boom", "fishspeech", "ok"), (None, "f5", "error")]


def test_resume_scores_only_what_is_missing(rows, folder):
    path = f"{folder}/done"
    C.resume_scores(rows.where("idx = 0"), path, None, ["task_id", "idx"])

    def never_a():
        def call(text):
            assert text != "a"
            return text + "!"
        return call

    out = C.resume_scores(rows.drop("status"), path, never_a, ["task_id", "idx"], pause=None)
    assert results(out, "translated_text") == [("a",), ("bad!",), (None,), (None,), ("c!",)]


def test_a_stopped_call_goes_on(spark, folder):
    path, schema = f"{folder}/done", "task_id bigint, idx int, original_text string"
    df = spark.createDataFrame([(i, 0, f"t{i}") for i in range(100)], schema)

    def dying():
        def call(text):
            if text == "t95":
                raise SystemExit("out of memory")  # not an error of the row: the task dies
            return text + "!"
        return call

    with pytest.raises(Exception):
        C.resume_scores(df, path, dying, ["task_id", "idx"], batches=8, pause=None)
    held = spark.read.option("recursiveFileLookup", "true").parquet(path)
    kept = {r.task_id for r in held.collect()}
    assert "t95" not in kept

    def only_new():
        def call(text):
            assert int(text[1:]) not in kept
            return text + "?"
        return call

    out = {r.task_id: r.translated_text for r in C.resume_scores(df, path, only_new, ["task_id", "idx"], batches=8, pause=None).collect()}
    assert out == {i: f"t{i}" + ("!" if i in kept else "?") for i in range(100)}


def test_an_empty_folder_and_failed_rows(spark, folder):
    import os

    path = f"{folder}/done"
    os.makedirs(path)
    df = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "task_id bigint, idx int, original_text string")

    def fails_on_x():
        def call(text):
            if text == "x":
                raise ValueError("no")
            return text + "1"
        return call

    options = {"batches": 2, "pause": None, "on_fail": "error", "max_retries": 1}
    first = {r.task_id: r.status for r in C.resume_scores(df, path, fails_on_x, ["task_id", "idx"], **options).collect()}
    assert first == {1: "failed", 2: "translated"}
    fine = lambda: lambda text: text + "2"
    again = {r.task_id: r.translated_text for r in C.resume_scores(df, path, fine, ["task_id", "idx"], **options).collect()}
    assert again == {1: None, 2: "y1"}
    retried = {r.task_id: r.translated_text for r in C.resume_scores(df, path, fine, ["task_id", "idx"], retry_failed=True, **options).collect()}
    assert retried == {1: "x2", 2: "y1"}


def test_analysis(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "task_id bigint, idx int, original_text string")
    out = C.analyze(df, "meeting_report", lambda: lambda prompt: prompt.split("TEXT:")[1]).orderBy("task_id").collect()
    assert [r.analysis for r in out] == ["x y", "z"]
    long = spark.createDataFrame([(1, i, f"w{i}") for i in range(12_000)], "task_id bigint, idx int, original_text string")
    one = C.analyze(long, "summary", lambda: lambda prompt: prompt.split("TEXT:\n")[1]).collect()
    assert len(one) == 1 and one[0].analysis == " ".join(f"w{i}" for i in range(12_000))
    bad = C.analyze(df, "poem", lambda: lambda prompt: prompt).collect()
    assert {(r.analysis, r.error) for r in bad} == {(None, "Unknown mode")}


def in_lists():
    """Takes lists; notes the size of each call in its answers, and fails on texts with an x until the third call."""
    calls = []

    @C.lists
    def call(texts):
        calls.append(len(texts))
        if "all" in texts:
            raise RuntimeError("whole call")
        return [ValueError("busy") if "x" in t and len(calls) < 3 else f"{t}:{len(calls)}/{len(texts)}" for t in texts]

    return call


def test_lists_and_one_retry_queue(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "x1", "b", "x2", "", None])], "idx int, original_text string").coalesce(1)
    out = C.score(df, in_lists, pause=None)
    assert results(out, "translated_text", "attempts") == [("a:1/4", 1), ("x1:3/2", 3), ("b:1/4", 1), ("x2:3/2", 3), (None, 0), (None, 0)]
    small = C.score(df.where("idx < 4"), in_lists, pause=None, list_size=3, on_fail="error", max_retries=1)
    assert results(small, "translated_text", "status", "error") == [
        ("a:1/3", "translated", None), (None, "failed", "busy"), ("b:1/3", "translated", None), (None, "failed", "busy")]


def test_a_call_that_fails_or_answers_short_fails_its_texts():
    assert C.ask(in_lists(), ["all", "a"]) == [(None, "whole call")] * 2
    assert C.ask(C.lists(lambda texts: texts[1:]), ["a", "b"]) == [(None, "1 results for 2 texts")] * 2
    gate = lambda result: 1 / 0 if result == "a" else "short" if len(result) < 2 else None
    found = C.attempts(C.lists(lambda texts: list(texts)), ["a", "b", "cc"], [0.0], gate)
    assert found == [(None, "division by zero", 2), (None, "short", 2), ("cc", None, 1)]


def test_one_pause_for_all_that_failed(monkeypatch):
    pauses = []
    monkeypatch.setattr(C.time, "sleep", pauses.append)
    found = C.attempts(lambda text: 1 / 0, [str(i) for i in range(50)], [2.0, 4.0])
    assert pauses == [2.0, 4.0] and found == [(None, "division by zero", 3)] * 50


def test_routing_asks_engine_by_engine(spark):
    rows = [(0, "a", "bark"), (1, "b", "f5"), (2, "c", "bark"), (3, "boom", "f5"), (4, "d", "broken")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "idx int, translated_text string, engine string, voice_sample string").coalesce(1)

    def engine(name):
        def build():
            if name == "broken":
                raise RuntimeError("no weights")
            return C.lists(lambda texts: [RuntimeError("illegal instruction") if t == "boom" and name == "f5" else f"{name}:{t}:{len(texts)}" for t in texts])
        return build

    out = C.route_scores(df, {n: engine(n) for n in ("bark", "f5", "fishspeech", "broken")}, fallback={"f5": "fishspeech"})
    assert results(out, "result", "engine_used", "status", "error") == [
        ("bark:a:2", "bark", "ok", None), ("f5:b:2", "f5", "ok", None), ("bark:c:2", "bark", "ok", None), ("fishspeech:boom:1", "fishspeech", "ok", None),
        (None, "broken", "error", "no weights")]
