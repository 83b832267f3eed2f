import json
import time
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators.speakers import speaker_turns
from voxlake.sources import export as X
from voxlake.sources import media as M
from voxlake.sources import states as S
from voxlake.sources import tables as T


def test_project_states(spark, folder):
    Path(folder, "a.json").write_text(json.dumps({"task_id": "a", "filename": "f", "extra": [1], "logs": [{"message": "m"}, {"message": "n", "style": "error"}]}, indent=2))
    Path(folder, "b.json").write_text(json.dumps({"task_id": "b", "status": "ok", "progress": 40, "created_at": "x"}))
    Path(folder, "c.json").write_text("{broken")
    Path(folder, "d.txt").write_text("{}")
    rows = {r.task_id: r for r in S.read_project_states(spark, folder).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].progress == 0.0 and rows["b"].progress == 40.0
    assert [(r.task_id, r.seq, r.message, r.style) for r in S.read_logs(spark, folder).orderBy("seq").collect()] == [("a", 0, "m", "info"), ("a", 1, "n", "error")]


def test_media_catalog_reads_no_content(spark, folder):
    for name in ("talk.MP4", "0123456789012345678901234567890_my clip.webm", "notes.txt"):
        Path(folder, name).write_bytes(b"123")
    catalog = M.media_catalog(spark, folder)
    plan = catalog._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split(">")[0]
    rows = {r.name: r for r in catalog.collect()}
    assert rows["talk.MP4"].media_type == "video/mp4" and rows["talk.MP4"].is_video and rows["talk.MP4"].stem == "talk"
    assert rows["notes.txt"].media_type == "application/octet-stream" and not rows["notes.txt"].is_video
    assert [r.display_name for n, r in rows.items() if n.startswith("0123")] == ["my clip.webm"]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_pcm(spark, folder, monkeypatch, width):
    monkeypatch.setattr(M, "BATCH_SAMPLES", 7)
    left = np.round(np.sin(np.arange(40) / 5) * 100) / 128
    right = -left / 2
    both = np.stack([left, right], axis=1).ravel()
    if width == 1:
        data = (np.round(both * 128) + 128).astype(np.uint8).tobytes()
    else:
        whole = np.round(both * 2 ** (8 * width - 1)).astype("<i8")
        data = b"".join(int(v).to_bytes(width, "little", signed=True) for v in whole)
    with wave.open(f"{folder}/x.wav", "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(width)
        out.setframerate(8000)
        out.writeframes(data)
    rows = M.read_pcm(spark, f"{folder}/x.wav").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(40))
    np.testing.assert_allclose([r.value for r in rows], left / 4, atol=0.005)
    meta = M.read_pcm_meta(spark, f"{folder}/*.wav").first()
    assert (meta.sample_rate, meta.duration, meta.channels) == (8000, 0.005, 2)


def test_exports(spark, folder):
    segments = spark.createDataFrame(
        [(1, 0, 0.0, 1.0, 0, "hi", "salut"), (1, 1, 1.0, 2.25, 0, "you", None), (1, 2, 2.0, 3.0, 1, "yes", "oui"), (2, 0, 0.0, 1.0, 5, "no", None)],
        "task_id bigint, idx int, start_s double, end_s double, speaker_id int, original_text string, translated_text string")
    speakers = spark.createDataFrame([(1, 0, "Ann")], "task_id bigint, speaker_id int, name string")
    X.export_markdown(speaker_turns(segments, speakers), f"{folder}/md", F.lit("today"))
    text = "".join(p.read_text() for p in sorted(Path(f"{folder}/md/task_id=1").glob("part-*.txt")))
    assert text == "# Transcription Export\n\n*Generated on today*\n\n---\n\n**Ann**:\nhi you\n\n**Speaker 2**:\nyes\n\n"
    X.export_json(segments, speakers, f"{folder}/json")
    rows = {r.task_id: r for r in spark.read.json(f"{folder}/json").collect()}
    assert [(g.speaker_name, g.text, g.end_s) for g in rows[1].grouped_segments] == [("Ann", "hi you", 2.25), ("Speaker 2", "yes", 3.0)]
    assert [s.idx for s in rows[1].raw_segments] == [0, 1, 2]
    lines = {r.task_id: r for r in X.transcript_lines(segments, speakers).collect()}
    assert lines[1].original_text == "[Ann]: hi\n[Ann]: you\n[Speaker 2]: yes" and lines[1].translated_text == "[Ann]: salut\n[Speaker 2]: oui"
    assert lines[2].translated_text is None
    assert X.bilingual_lines(segments).where("task_id = 1").first().text == "[0.0s] hi -> salut\n[1.0s] you -> \n[2.0s] yes -> oui"


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_line_digests_take_every_character_of_every_line(spark, batch):
    from hashlib import md5

    texts = {1: ["b", "", "a", "été", "a"], 2: [""], 3: ["x" * 9, "y"]}
    lines = spark.createDataFrame([(k, v) for k, vs in texts.items() for v in vs], "task_id bigint, value string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        got = {r.task_id: (r.lines, r.content) for r in X.line_digests(lines).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {k: (len(vs), md5("\n".join(sorted(vs)).encode()).hexdigest()) for k, vs in texts.items()}


def test_export_takes_less_time_than_sparks_writer_and_says_the_same(spark, folder):
    turns = spark.range(1500).select(
        F.col("id").alias("task_id"), F.lit(0).alias("turn_no"), F.lit(0).alias("part"), F.lit("Ann").alias("speaker_name"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("été "), "id", F.lit("\n\nx"))).alias("text")).persist()
    document = X.markdown_document(turns, F.lit("today"))

    def plain(path):
        document.repartitionByRange("task_id").sortWithinPartitions("task_id", "turn_no", "part").select("task_id", "value").write.partitionBy("task_id").mode("overwrite").text(path)

    def seconds(write, path):
        write(path)
        start = time.perf_counter()
        write(path)  # over what is there
        return time.perf_counter() - start

    slow, fast = seconds(plain, f"{folder}/plain"), seconds(lambda path: X.export_markdown(turns, path, F.lit("today")), f"{folder}/md")
    texts = lambda top: {p.parent.name: p.read_bytes() for p in Path(top).glob("task_id=*/part-*.txt")}
    assert texts(f"{folder}/md") == texts(f"{folder}/plain") and len(texts(f"{folder}/md")) == 1500
    assert {p.name for p in Path(f"{folder}/md").iterdir() if not p.name.startswith("task_id=")} <= {"_SUCCESS", "._SUCCESS.crc"}
    assert X.line_digests(X.read_markdown(spark, f"{folder}/md")).exceptAll(X.line_digests(X.read_markdown(spark, f"{folder}/plain"))).count() == 0
    X.export_markdown(turns.limit(0), f"{folder}/none")
    assert [p.name for p in Path(f"{folder}/none").glob("[!.]*")] == ["_SUCCESS"]
    turns.unpersist()
    assert fast < 0.6 * slow, (fast, slow)


def test_many_folders_are_listed_by_few_tasks(spark, folder):
    lines = spark.range(40).select(F.col("id").alias("task_id"), F.concat(F.lit("line "), "id").alias("value"))
    lines.coalesce(1).write.partitionBy("task_id").text(f"{folder}/md")
    before = spark.conf.get(X.LISTING, None)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        read = X.read_markdown(spark, f"{folder}/md")
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    assert spark.conf.get(X.LISTING, None) == before
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * context.defaultParallelism < 40
    assert {(r.task_id, r.value) for r in read.collect()} == {(i, f"line {i}") for i in range(40)}


def test_the_export_is_checked_by_whole_contents():
    import __spark_entry__ as entry

    sql = entry.oracle_sql()["a05_export_markdown"]
    assert "md5(string_agg(line, E'\\n' ORDER BY line)) AS content" in sql and "substr" not in sql


def test_pushdown_reaches_the_scan(spark):
    orders = T.load(spark, "/root/testdata/sf0.001", "orders").where("o_orderkey = 5").select("o_orderkey", "o_orderstatus")
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan and "o_totalprice" not in plan
