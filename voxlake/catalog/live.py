"""Queries that stream the given tables, or write and read files derived from them.

Streams read their table as files, run until all of it is consumed, and write below the
session's checkpoint folder, which is shared on a cluster.
"""

from __future__ import annotations

import io
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.catalog.bindings import ACTIVITY, LOGS, PROGRESS, Tables, micros
from voxlake.catalog.embeddings import upper_provider
from voxlake.catalog.registry import query
from voxlake.catalog.speech import TURN_VIEWS
from voxlake.catalog.workflow import PROGRESS_CTE, SUMMARY_COLUMNS, flat_summary
from voxlake.operators import scoring as C
from voxlake.operators.speakers import speaker_turns
from voxlake.plans.spread import tasks_for
from voxlake.session import checkpoint_dir
from voxlake.sources import export as X
from voxlake.sources.media import decode_pcm
from voxlake.sources.states import read_project_states
from voxlake.streaming import progress as P
from voxlake.streaming.refresh import LiveDashboard, start_dashboard
from voxlake.streaming.versioned import VersionedTable, merge_states

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def scratch(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/voxlake/{name}-{uuid.uuid4().hex}"


def buckets(rows: DataFrame) -> int:
    """Buckets of a table with about so many rows: their number grows with it, not their size."""
    return tasks_for(rows, rows.count())


def stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream of its files, few at a time."""
    # As a pattern, the path may be one file or a folder of files.
    pattern = f"{t.folder}/{name[:-1]}[{name[-1]}].parquet"
    return (
        t.spark.readStream.schema(t.raw(name).schema)
        .option("maxFilesPerTrigger", 64)
        .option("pathGlobFilter", "*.parquet")
        .parquet(pattern)
    )


def progress(t: Tables) -> DataFrame:
    rows = t.spark.sql(PROGRESS, events=stream(t, "events"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def in_micros(df: DataFrame) -> DataFrame:
    return df.withColumns({name: micros(F.col(name)) for name, kind in df.dtypes if kind.startswith("timestamp")})


def run(t: Tables, out: DataFrame, name: str, mode: str) -> str:
    """Consume all input into a folder of batches and return it."""
    folder = scratch(t, name)
    job = (
        out.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(P.append_changes(f"{folder}/data"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return f"{folder}/data"


LATEST = """SELECT task_id, epoch_us(max(ts)) AS ts, arg_max(phase, ts) AS phase, arg_max(percent, ts) AS percent, arg_max(message, ts) AS message
FROM progress GROUP BY task_id"""


@query("i05_latest_progress", LATEST)
def _(t: Tables):
    folder = run(t, P.latest_progress(progress(t)), "latest", "update")
    return in_micros(P.read_current(t.spark, folder, ["task_id"]))


TAIL = "SELECT task_id, seq, message, style FROM logs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) <= 10"


@query("i06_stream_log_tail", TAIL)
def _(t: Tables):
    before = t.spark.conf.get(STATE_STORE)
    t.spark.conf.set(STATE_STORE, P.ROCKSDB)
    try:
        folder = run(t, P.stream_log_tail(t.spark.sql(LOGS, events=stream(t, "events")), 10), "tail", "update")
    finally:
        t.spark.conf.set(STATE_STORE, before)
    return P.read_newest_groups(t.spark, folder, ["task_id"])


# A session ends six hours after its last row; the stream gives those the watermark has passed.
SESSIONS = """SELECT task_id, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS rows FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts) AS n FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM progress))
GROUP BY task_id, n"""


@query("i07_sessions", "SELECT task_id, epoch_us(start_ts) AS start_ts, epoch_us(last_ts) AS last_ts, rows FROM sessions", sessions=SESSIONS)
def _(t: Tables):
    return in_micros(P.sessions(t.progress, 6 * 3600))


@query("i07_stream_sessions", "SELECT task_id, epoch_us(start_ts) AS start_ts, epoch_us(last_ts) AS last_ts, rows FROM sessions WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM progress) - INTERVAL 10 SECOND", sessions=SESSIONS)
def _(t: Tables):
    before = t.spark.conf.get(P.LOCAL_MERGE)
    t.spark.conf.set(P.LOCAL_MERGE, "true")
    try:
        folder = run(t, P.stream_sessions(progress(t), "6 hours", "10 seconds"), "sessions", "append")
    finally:
        t.spark.conf.set(P.LOCAL_MERGE, before)
    return in_micros(t.spark.read.parquet(folder).drop("batch"))


WINDOWS = """SELECT task_id, w AS start_ts, w + INTERVAL 6 HOUR AS end_ts, count(*) AS rows, round(avg(percent), 6) AS percent FROM (
  SELECT *, unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 3 HOUR]) AS w FROM progress)
GROUP BY task_id, w"""


@query("i08_sliding_windows", "SELECT task_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, rows, percent FROM windows", windows=WINDOWS)
def _(t: Tables):
    rows = t.progress.withColumn("ts", F.col("ts").cast("timestamp"))
    return in_micros(P.stream_windows(rows, "6 hours", "3 hours", "")).withColumn("percent", F.round("percent", 6))


@query("i08_stream_windows", "SELECT task_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, rows, percent FROM windows WHERE end_ts <= (SELECT max(ts) FROM progress) - INTERVAL 10 SECOND", windows=WINDOWS)
def _(t: Tables):
    folder = run(t, P.stream_windows(progress(t), "6 hours", "3 hours", "10 seconds"), "windows", "append")
    return in_micros(t.spark.read.parquet(folder).drop("batch")).withColumn("percent", F.round("percent", 6))


@query("i09_refresh_table", LATEST)
def _(t: Tables):
    folder = scratch(t, "refresh")
    P.start_refresh(progress(t), f"{folder}/data", f"{folder}/checkpoint", once=True).awaitTermination()
    P.compact(t.spark, f"{folder}/data", f"{folder}/compact", ["task_id"])
    return in_micros(P.read_current(t.spark, f"{folder}/compact", ["task_id"]))


@query(
    "i09_dashboard_refresh",
    f"SELECT {SUMMARY_COLUMNS} FROM live_tasks t LEFT JOIN progress_by_task p ON t.task_id = p.task_id",
    live_tasks="""SELECT t.* REPLACE (coalesce(l.m.phase, t.phase) AS phase, coalesce(l.m.percent, t.progress) AS progress) FROM tasks t LEFT JOIN (
      SELECT task_id, last({'phase': phase, 'percent': percent} ORDER BY ts, seq) AS m FROM activity GROUP BY task_id) l ON l.task_id = t.task_id""",
    live_steps="""SELECT s.* REPLACE (coalesce(u.status, s.status) AS status) FROM steps s LEFT JOIN (
      SELECT task_id, task_name, last(status ORDER BY seq) FILTER (WHERE length(status) > 0) AS status FROM activity WHERE task_name IS NOT NULL GROUP BY task_id, task_name) u
      ON u.task_id = s.task_id AND u.task_name = s.task_name""",
    progress_by_task=PROGRESS_CTE.replace("FROM steps s", "FROM live_steps s"),
)
def _(t: Tables):
    folder = scratch(t, "board")
    board = LiveDashboard.at(t.spark, folder, buckets=buckets(t.raw("lineitem")))
    board.create(t.tasks, t.steps)
    activity = t.spark.sql(ACTIVITY, events=stream(t, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    start_dashboard(activity, board, f"{folder}/checkpoint", once=True).awaitTermination()
    return flat_summary(board.rows.read())


@query(
    "a09_upsert_sink",
    """SELECT coalesce(b.task_id, u.task_id) AS task_id, coalesce(u.status, b.status) AS status, b.phase, u.message FROM (SELECT task_id, status, phase FROM tasks) b
    FULL JOIN (SELECT user_id + 100 AS task_id, last(event_type ORDER BY event_id) FILTER (WHERE event_id % 3 <> 0) AS status,
      last(props ORDER BY event_id) FILTER (WHERE event_id % 5 <> 0 AND props IS NOT NULL) AS message FROM events GROUP BY 1) u ON u.task_id = b.task_id""",
)
def _(t: Tables):
    def state(**fields):
        return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())

    folder = scratch(t, "states")
    table = VersionedTable(t.spark, f"{folder}/table", ("task_id",), buckets=buckets(t.raw("orders")))
    table.create(t.tasks.select("task_id", state(status=F.col("status"), phase=F.col("phase")).alias("state")))
    given = lambda column, n: F.when(F.col("event_id") % n != 0, F.col(column))
    news = stream(t, "events").select(
        (F.col("user_id") + 100).alias("task_id"), F.col("event_id").alias("seq"), state(status=given("event_type", 3), message=given("props", 5)).alias("state"))
    job = news.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(table.sink(merge=merge_states())).trigger(availableNow=True).start()
    job.awaitTermination()
    return table.read().select("task_id", *[F.col("state")[k].alias(k) for k in ("status", "phase", "message")])


@query(
    "a02_project_states",
    """SELECT CAST(task_id AS VARCHAR) AS task_id, filename, status, coalesce(progress, CAST(0 AS DOUBLE)) AS progress FROM tasks WHERE task_id // 500 % 5 <> 4""",
)
def _(t: Tables):
    # Files of up to 500 projects each; every fifth file is cut short and so cannot be read.
    state = F.struct(F.col("task_id").cast("string").alias("task_id"), "filename", "status", "progress")
    files = (
        t.tasks.groupBy(F.floor(F.col("task_id") / 500).alias("file_no"))
        .agg(F.to_json(F.collect_list(state)).alias("value"))
        .withColumn("value", F.when(F.col("file_no") % 5 == 4, F.expr("left(value, 30)")).otherwise(F.col("value")))
    )
    folder = scratch(t, "states")
    files.repartition("file_no").write.partitionBy("file_no").text(folder)
    return read_project_states(t.spark, folder, "*.txt").select("task_id", "filename", "status", "progress")


@query(
    "a04_decode_pcm",
    """SELECT series_id, pos, round(greatest(-32768, least(32767, round(value * 32768))) / 32768, 6) AS value FROM samples""",
)
def _(t: Tables):
    # Clips of 64 samples, written as stereo files whose channels differ by a constant.
    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.floor(np.abs(pdf.sort_values("pos")["value"].to_numpy()) * 32768 + 0.5) * np.sign(pdf.sort_values("pos")["value"].to_numpy())
        mono = np.clip(values, -32768, 32767).astype("<i2")
        out = io.BytesIO()
        with wave.open(out, "wb") as target:
            target.setnchannels(2)
            target.setsampwidth(2)
            target.setframerate(16000)
            target.writeframes(np.stack([mono, mono], axis=1).tobytes())
        return pd.DataFrame({"path": [f"{pdf['series_id'].iloc[0]}/{pdf['clip'].iloc[0]}"], "content": [out.getvalue()]})

    clips = t.samples.withColumn("clip", F.floor(F.col("pos") / 64)).groupBy("series_id", "clip").applyInPandas(encode, "path string, content binary")
    parts = F.split("series_id", "/")
    return decode_pcm(clips).select(
        parts[0].cast("bigint").alias("series_id"), (parts[1].cast("bigint") * 64 + F.col("pos")).alias("pos"), F.round("value", 6).alias("value")
    )


@query(
    "a05_export_markdown",
    """SELECT CAST(task_id AS BIGINT) AS task_id, count(*) AS lines, md5(string_agg(line, E'\\n' ORDER BY line)) AS content FROM (
      SELECT task_id, unnest(string_split(value, E'\\n')) AS line FROM (
        SELECT task_id, '**' || speaker_name || E'**:\\n' || text || E'\\n' AS value FROM named_turns
        UNION ALL SELECT DISTINCT task_id, E'# Transcription Export\\n\\n*Generated on today*\\n\\n---\\n' FROM named_turns)) GROUP BY task_id""",
    **TURN_VIEWS,
)
def _(t: Tables):
    folder = scratch(t, "markdown")
    X.export_markdown(speaker_turns(t.segments, t.speakers), folder, F.lit("today"))
    return X.line_digests(X.read_markdown(t.spark, folder))


@query(
    "j06_resume_scores",
    """SELECT task_id, idx, CASE WHEN used THEN CASE WHEN contains(original_text, '7') THEN original_text ELSE upper(trim(original_text)) END ELSE translated_text END AS translated_text,
    CASE WHEN used THEN 'translated' ELSE status END AS status
    FROM (SELECT *, coalesce(length(original_text) > 0, FALSE) AND status <> 'failed' AS used FROM segments)""",
)
def _(t: Tables):
    folder = scratch(t, "scores")
    rows = t.segments.drop("ts")
    C.resume_scores(rows.where(F.col("status") == "completed"), folder, upper_provider, ["task_id", "idx"], pause=None)
    return C.resume_scores(rows, folder, upper_provider, ["task_id", "idx"], pause=None).select("task_id", "idx", "translated_text", "status")
