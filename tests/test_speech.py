import random

import pytest
from pyspark.sql import functions as F

from voxlake.operators import lifecycle as L
from voxlake.operators import segments as S
from voxlake.operators import speakers as P

SEGMENT = "task_id bigint, idx int, start_s double, end_s double, speaker_id int, original_text string"
SPEAKER = "task_id bigint, speaker_id int, name string, action string, include boolean, merged_into int, merged_speakers array<int>, sample_path string"


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([(1, i, float(i), i + 1.0, s, f" t{i} ") for i, s in enumerate([0, 0, 1, 2, 2, 3, 9, 0])], SEGMENT)


@pytest.fixture(scope="module")
def speakers(spark):
    return spark.createDataFrame([
        (1, 0, "Ann", "dub", None, None, [2], "/s/0"),
        (1, 1, None, "remove", None, 0, None, None),
        (1, 2, "Cy", None, False, None, None, "/s/2"),
        (1, 3, " ", "dub", None, 1, None, ""),
    ], SPEAKER)


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("idx").collect()]


def test_merge_first(segments, speakers):
    assert pairs(P.effective_speakers(segments, speakers), "effective_speaker_id", "action") == [
        (0, "dub"), (0, "dub"), (0, "dub"), (0, "dub"), (0, "dub"), (1, "remove"), (9, "dub"), (0, "dub")]
    assert pairs(P.apply_speaker_edits(segments, speakers), "idx", "speaker_id") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (6, 9), (7, 0)]


def test_filter_first(segments, speakers):
    # 1 is removed, 2 is not included, 3 merges into the removed 1.
    assert pairs(P.apply_speaker_edits(segments, speakers, "filter_first"), "idx", "speaker_id") == [(0, 0), (1, 0), (6, 9), (7, 0)]
    assert pairs(P.drop_removed(segments, speakers), "idx") == [(0,), (1,), (3,), (4,), (5,), (6,), (7,)]
    with pytest.raises(ValueError):
        P.apply_speaker_edits(segments, speakers, "both")


def test_later_entry_of_the_merge_map_wins(spark):
    config = spark.createDataFrame([(1, 0, [3]), (1, 1, [3, 4]), (1, 4, None)], "task_id bigint, speaker_id int, merged_speakers array<int>")
    config = config.withColumn("merged_into", F.when(F.col("speaker_id") == 4, 0))
    assert {(r.speaker_id, r.master) for r in P.merge_map(config).collect()} == {(3, 1), (4, 0)}


def test_voice_sample_falls_back_to_the_own_one(segments, speakers):
    assert pairs(P.voice_sample(segments, speakers), "voice_sample") == [("/s/0",)] * 5 + [(None,), (None,), ("/s/0",)]


def test_names(segments, speakers):
    assert pairs(P.with_speaker_name(segments, speakers), "speaker_name")[2:7] == [("Speaker 2",), ("Cy",), ("Cy",), (" ",), ("Speaker 10",)]
    assert pairs(P.with_speaker_name(segments, speakers, True), "speaker_name")[5] == ("Speaker 4",)


@pytest.mark.parametrize("rows", [0, 2])
def test_turns(spark, chunked, speakers, rows):
    data = [(1, 0, 5.0, 6.0, None, "b"), (1, 1, 1.0, 2.0, None, " a\n"), (1, 2, 7.0, 9.0, 0, None), (1, 3, 7.5, 8.0, 0, "c"), (1, 4, 8.0, 8.5, 1, "d"), (2, 0, 0.0, 1.0, 1, "x")]
    with chunked(rows):
        out = P.speaker_turns(spark.createDataFrame(data, SEGMENT), speakers).orderBy("task_id", "turn_no").collect()
    assert [(r.task_id, r.turn_no, r.part, r.speaker_id, r.start_s, r.end_s, r.segments, r.text) for r in out] == [
        (1, 0, 0, None, 1.0, 6.0, 2, "a b"), (1, 1, 0, 0, 7.0, 8.0, 2, " c"), (1, 2, 0, 1, 8.0, 8.5, 1, "d"), (2, 0, 0, 1, 0.0, 1.0, 1, "x")]


def test_long_turns_come_in_parts(spark, chunked, monkeypatch):
    monkeypatch.setattr(P, "TURN_ROWS", 10)
    rows = [(1, i, float(i), i + 0.5, 0, str(i)) for i in range(57)]
    with chunked(8):
        out = P.speaker_turns(spark.createDataFrame(rows, SEGMENT)).orderBy("part").collect()
    assert len(out) > 3 and {(r.turn_no, r.start_s, r.end_s, r.segments) for r in out} == {(0, 0.0, 56.5, 57)}
    assert " ".join(r.text for r in out).split() == [str(i) for i in range(57)]


@pytest.mark.parametrize("rows", [0, 10])
def test_reference_equals_a_loop(spark, chunked, rows):
    rng = random.Random(5)
    data = [(1, i, float(i), i + rng.choice([0.0, 0.1, 0.5, 2.0, 4.0]), i % 2, "") for i in range(400)]
    with chunked(rows):
        out = P.select_reference(spark.createDataFrame(data, SEGMENT)).collect()
    for speaker in (0, 1):
        expected, used = [], 0.0
        for r in sorted((r for r in data if r[4] == speaker), key=lambda r: r[3] - r[2], reverse=True):
            if used >= 15.0 - 1e-9:
                break
            expected.append((r[1], round(used + 0.5 * len(expected), 6)))
            used += r[3] - r[2]
        assert sorted((r.idx, round(r.offset_s, 6)) for r in out if r.speaker_id == speaker) == sorted(expected)


def test_parts_of_joined_text(spark):
    df = spark.createDataFrame([(1, i, str(i)) for i in range(7)] + [(2, 0, None)], "task_id bigint, idx int, original_text string")
    out = S.concat_text(df, part_rows=3).orderBy("task_id", "part").collect()
    assert [(r.task_id, r.part, r.text) for r in out] == [(1, 0, "0 1 2"), (1, 1, "3 4 5"), (1, 2, "6"), (2, 0, "")]


def test_edits(spark):
    base = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y")], "task_id bigint, idx int, original_text string, translated_text string")
    edits = spark.createDataFrame(
        [(1, 0, 1, "A", "X", True, True), (1, 0, 2, None, None, True, False), (1, 1, 1, "no", "Y", False, True), (1, 5, 1, "z", "z", True, True)],
        "task_id bigint, idx int, seq int, original_text string, translated_text string, has_original boolean, has_translated boolean")
    assert pairs(S.merge_edits(base, edits), "original_text", "translated_text") == [(None, "X"), ("b", "Y")]


def test_config_merge_and_groups(spark):
    old = spark.createDataFrame([(1, "0", "Ann", "/s/0"), (1, "1", "Bob", "/s/1")], "task_id bigint, speaker_key string, name string, sample_path string")
    new = spark.createDataFrame([(1, "0", None, "remove"), (1, "_x", "no", "dub"), (1, "7", "Eve", "dub")], "task_id bigint, speaker_key string, name string, action string")
    out = {r.speaker_key: (r.name, r.action, r.sample_path) for r in P.merge_speaker_config(old, new).collect()}
    assert out == {"0": ("Ann", "remove", "/s/0"), "7": ("Eve", "dub", None)}
    groups = spark.createDataFrame([(1, 0, [2, 0]), (1, 1, [3])], "task_id bigint, group_no int, ids array<int>")
    cards = spark.createDataFrame([(1, i, f"n{i}", i != 1) for i in range(4)], "task_id bigint, speaker_id int, name string, is_dub boolean")
    got = {r.speaker_id: (r.action, r.merged_into, r.merged_speakers) for r in P.speakers_from_groups(groups, cards).collect()}
    assert got == {0: ("remove", 2, []), 1: ("remove", None, []), 2: ("dub", None, [0]), 3: ("dub", None, [])}


def test_upsert_keeps_the_creation_time(spark):
    base = spark.createDataFrame([(1, 0, "a", 1, 1), (1, 1, "b", 1, 1)], "task_id bigint, idx int, original_text string, created_at int, updated_at int")
    updates = spark.createDataFrame([(1, 1, "B", 1), (1, 1, None, 2), (1, 2, "c", 1)], "task_id bigint, idx int, original_text string, seq int")
    out = L.upsert_segments(base, updates, F.lit(9))
    assert pairs(out, "original_text", "created_at", "updated_at") == [("a", 1, 1), (None, 1, 9), ("c", 9, 9)]


def test_lookup_prefers_idx(spark):
    df = spark.createDataFrame([(1, 5), (1, 1), (1, 9)], "task_id bigint, idx int")
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 0), (1, 7), (2, 0)], "task_id bigint, asked int")
    got = {(r.task_id, r.asked): (r.matched_by, r.idx) for r in S.lookup_segment(df, asked).collect()}
    assert got == {(1, 1): ("idx", 1), (1, 2): ("place", 9), (1, 0): ("place", 1), (1, 7): (None, None), (2, 0): (None, None)}


def test_verdicts(spark):
    rows = [(1, "failed", None, None), (1, "pending", "x", None), (2, "pending", None, None), (3, "completed", "x", "e"), (4, "completed", "x", ""), (4, "completed", "x", "e")]
    df = spark.createDataFrame(rows, "task_id bigint, status string, audio_path string, error string")
    assert {r.task_id: r.verdict for r in S.assembly_verdict(df).collect()} == {1: "all_failed", 2: "none_created", 3: "all_silent", 4: "ok"}


@pytest.mark.parametrize("rows", [0, 3])
def test_batches(spark, chunked, rows):
    df = spark.createDataFrame([(1, i) for i in range(11)] + [(2, i) for i in range(10)], "task_id bigint, idx int")
    with chunked(rows):
        out = S.assign_batches(df, 5, ["task_id"], ["idx"]).orderBy("task_id", "idx").collect()
    assert [(r.batch_no, r.total_batches) for r in out] == [(i // 5 + 1, 3) for i in range(11)] + [(i // 5 + 1, 2) for i in range(10)]


def test_review_replaces_only_given_lists(spark):
    base = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "task_id bigint, idx int, original_text string")
    edits = spark.createDataFrame([(1, 4, "A"), (2, 0, "ignored")], "task_id bigint, idx int, original_text string")
    reviewed = spark.createDataFrame([(1,), (3,)], "task_id bigint")
    assert {tuple(r) for r in L.save_review(base, edits, reviewed).collect()} == {(1, 4, "A"), (2, 0, "b")}


def test_an_edit_changes_the_first_of_equal_indexes(spark):
    from voxlake.operators import segments as S

    segments = spark.createDataFrame([(1, 0, 5.0, "b", None), (1, 0, 2.0, "a", None), (1, 1, 0.0, "c", None)],
                                     "task_id bigint, idx int, start_s double, original_text string, translated_text string")
    edits = spark.createDataFrame([(1, 0, 1, "new", None, True, False)],
                                  "task_id bigint, idx int, seq int, original_text string, translated_text string, has_original boolean, has_translated boolean")
    assert sorted(r.original_text for r in S.merge_edits(segments, edits).collect()) == ["b", "c", "new"]
