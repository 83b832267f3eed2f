"""The given tables seen as projects, steps, segments, speakers, signals and logs.

``Tables`` builds each view for Spark; ``CTES`` has the same views as SQL for the check tool.
Views that SQL says the same way in both share one text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.plans.ordered import Ordered
from voxlake.plans.spread import spread
from voxlake.sources.tables import load

TASKS = """
SELECT o_orderkey AS task_id,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE concat('media_', CAST(o_orderkey AS STRING), '.mp4') END AS filename,
  CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE concat('orig_', CAST(o_orderkey AS STRING), '.mkv') END AS original_filename,
  concat('/media/', CAST(o_orderkey AS STRING), '.wav') AS file_path,
  CASE WHEN o_orderkey % 6 = 0 THEN 'youtube' ELSE 'upload' END AS source,
  CASE o_orderkey % 11 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' WHEN 2 THEN 'paused' WHEN 3 THEN 'failed'
    WHEN 4 THEN 'queued' WHEN 5 THEN 'awaiting_validation' WHEN 6 THEN 'running' WHEN 7 THEN 'cancelled'
    WHEN 8 THEN 'error' WHEN 9 THEN 'resuming' ELSE NULL END AS status,
  CASE o_custkey % 13 WHEN 0 THEN 'init' WHEN 1 THEN 'identifying' WHEN 2 THEN 'awaiting_speaker_validation'
    WHEN 3 THEN 'transcribing' WHEN 4 THEN 'awaiting_transcription_review' WHEN 5 THEN 'translating'
    WHEN 6 THEN 'awaiting_translation_review' WHEN 7 THEN 'synthesizing' WHEN 8 THEN 'awaiting_audio_validation'
    WHEN 9 THEN 'recomposing' WHEN 10 THEN 'complete' WHEN 11 THEN 'loading' ELSE NULL END AS phase,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS progress,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN ' ' ELSE 'fr' END AS src_lang,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'es' END AS tgt_lang,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS separate_audio,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'f5' WHEN 2 THEN 'bark' ELSE 'fishspeech' END AS tts_engine,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('outputs/', CAST(o_orderkey AS STRING), '/final.mp4') END AS output_path,
  CASE WHEN o_orderkey % 11 = 3 THEN 'engine stopped' ELSE NULL END AS error_message,
  o_orderdate AS created_at, o_orderdate AS updated_at,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 7 = 0 END AS was_running_at_shutdown,
  CAST(o_custkey % 4 AS INT) AS resume_attempts
FROM {orders}
"""

# Line numbers repeat inside an order, so a step is one (order, line number) group.
STEPS = """
SELECT l_orderkey AS task_id, concat('step_', CAST(l_linenumber AS STRING)) AS task_name,
  CAST(l_linenumber - 1 AS INT) AS task_order,
  CASE WHEN l_linenumber < 3 THEN 'identifying' ELSE 'translating' END AS phase,
  CASE WHEN l_linenumber % 2 = 0 THEN 'speech' ELSE 'text' END AS task_group,
  CASE CAST(sum(l_quantity) AS INT) % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped'
    WHEN 3 THEN 'running' WHEN 4 THEN 'pending' ELSE 'queued' END AS status,
  CAST(1 + count(*) % 4 AS INT) AS attempt_count, 3 AS max_attempts,
  min(l_shipdate) AS created_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

STEP_UPDATES = """
SELECT l_orderkey AS task_id, concat('step_', CAST(l_linenumber AS STRING)) AS task_name,
  (l_partkey * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS seq, l_shipdate AS at,
  CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'skipped' WHEN 3 THEN ''
    ELSE NULL END AS status,
  CASE WHEN l_partkey % 3 = 0 THEN concat('out', CAST(l_suppkey AS STRING)) ELSE NULL END AS output_data,
  CASE WHEN l_partkey % 4 = 0 THEN concat('ckpt', CAST(l_suppkey AS STRING)) ELSE NULL END AS checkpoint_data,
  CASE WHEN l_returnflag = 'R' THEN concat('err', CAST(l_suppkey AS STRING)) ELSE NULL END AS error_message,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN concat('trace', CAST(l_partkey AS STRING)) ELSE NULL END AS error_traceback
FROM {lineitem}
"""

COMMANDS = """
SELECT user_id AS task_id, event_id AS seq,
  CASE event_id % 9 WHEN 0 THEN 'start' WHEN 1 THEN 'pause' WHEN 2 THEN 'cancel' WHEN 3 THEN 'resume' WHEN 4 THEN 'restart'
    WHEN 5 THEN 'confirm_speakers' WHEN 6 THEN 'confirm_transcription' WHEN 7 THEN 'confirm_translation'
    ELSE 'confirm_audio' END AS command,
  CASE event_id % 8 WHEN 0 THEN 'init' WHEN 1 THEN 'identifying' WHEN 2 THEN 'transcribing' WHEN 3 THEN 'translating'
    WHEN 4 THEN 'synthesizing' WHEN 5 THEN 'recomposing' WHEN 6 THEN 'complete' ELSE NULL END AS from_phase
FROM {events}
"""

# Segments without their index: {start} is the time in seconds since 2024-01-01.
SEGMENT_ROWS = """
SELECT user_id AS task_id, event_id, ts, {start} AS start_s, {start} + value AS end_s,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS speaker_id,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat(' ', event_type, ' ', props, ' ') END AS original_text,
  CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '!!! ...' WHEN 3 THEN ' ' WHEN 4 THEN 'été à Noël'
    ELSE concat('tr ', props) END AS translated_text,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('synth/', CAST(event_id AS STRING), '.wav') END AS audio_path,
  CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status,
  CASE event_id % 7 WHEN 0 THEN 'boom' WHEN 1 THEN '' ELSE NULL END AS error
FROM {events}
"""

# One configuration per customer and listed speaker; speaker 4 is in no configuration.
SPEAKERS = """
SELECT task_id, speaker_id,
  CASE speaker_id WHEN 0 THEN 'Alice' WHEN 1 THEN 'Bob'
    WHEN 2 THEN CASE WHEN task_id % 7 = 0 THEN NULL WHEN task_id % 7 = 1 THEN ' ' ELSE 'Carol' END ELSE 'Dan' END AS name,
  CASE speaker_id WHEN 0 THEN CASE WHEN task_id % 10 = 9 THEN 'remove' ELSE 'dub' END
    WHEN 1 THEN CASE WHEN task_id % 3 = 0 THEN 'remove' ELSE 'dub' END
    WHEN 2 THEN CASE WHEN task_id % 4 = 0 THEN NULL ELSE 'dub' END
    ELSE CASE WHEN task_id % 5 = 0 THEN 'dub' ELSE 'remove' END END AS action,
  CASE WHEN speaker_id = 1 THEN task_id % 5 <> 0 ELSE NULL END AS include,
  CASE WHEN speaker_id = 2 AND task_id % 2 = 0 THEN 0 WHEN speaker_id = 3 AND task_id % 6 = 0 THEN 1 ELSE NULL END AS merged_into,
  CASE WHEN speaker_id = 3 AND task_id % 3 = 1 THEN '2' ELSE NULL END AS merged_text,
  CASE speaker_id WHEN 0 THEN '/s/0.wav' WHEN 2 THEN '/s/2.wav' WHEN 3 THEN '' ELSE NULL END AS sample_path
FROM {listed}
"""

TRANSCRIPTS = """
SELECT conv_id AS task_id, CAST(turn AS INT) AS idx, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker_id,
  text AS original_text FROM {conversations}
"""

META = """
SELECT c_custkey AS series_id, 16 AS sample_rate, abs(c_acctbal) / 10 AS duration FROM {customer}
"""

PROGRESS = """
SELECT user_id AS task_id, ts, event_type AS phase, least(value, CAST(100 AS DOUBLE)) AS percent, props AS message FROM {events}
"""

LOGS = """
SELECT user_id AS task_id, event_id AS seq, props AS message, event_type AS style FROM {events}
"""

# Messages of running projects; one in three is about a step.
ACTIVITY = """
SELECT user_id AS task_id, ts, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS phase,
  least(value, CAST(100 AS DOUBLE)) AS percent, props AS message,
  CASE WHEN event_id % 3 = 0 THEN concat('step_', CAST(event_id % 7 + 1 AS STRING)) ELSE NULL END AS task_name,
  CASE event_id % 15 WHEN 0 THEN 'completed' WHEN 3 THEN 'running' WHEN 6 THEN 'skipped' WHEN 9 THEN '' ELSE 'failed' END AS status
FROM {events}
"""

EPOCH = "2024-01-01 00:00:00"
SPARK_START = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', ts) / 1e6D"
DUCK_START = "CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 1e6"


def micros(ts):
    """Microseconds since 1970 of a time, whatever the session's time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz"))


class Tables:
    """The views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def _sql(self, text: str, **views: DataFrame) -> DataFrame:
        return self.spark.sql(text, **views)

    @cached_property
    def tasks(self) -> DataFrame:
        return self._sql(TASKS, orders=self.raw("orders"))

    @cached_property
    def steps(self) -> DataFrame:
        # By project, so that its steps are made, counted and joined to it without another shuffle of them.
        lines = self.raw("lineitem")
        return self._sql(STEPS, lineitem=spread(lines, ["l_orderkey"]))

    @cached_property
    def step_updates(self) -> DataFrame:
        return self._sql(STEP_UPDATES, lineitem=self.raw("lineitem"))

    @cached_property
    def commands(self) -> DataFrame:
        return self._sql(COMMANDS, events=self.raw("events"))

    @cached_property
    def segments(self) -> DataFrame:
        rows = self._sql(SEGMENT_ROWS.replace("{start}", SPARK_START), events=self.raw("events"))
        numbered = Ordered.of(rows, ["task_id"], ["ts", "event_id"], F.col("start_s")).row_number("__n").done()
        return numbered.withColumn("idx", (F.col("__n") - 1).cast("int")).drop("__n")

    @cached_property
    def intervals(self) -> DataFrame:
        rows = SEGMENT_ROWS.replace("{start}", SPARK_START)
        return self._sql(f"SELECT task_id AS series_id, start_s, end_s FROM ({rows})", events=self.raw("events"))

    @cached_property
    def speakers(self) -> DataFrame:
        listed = self.raw("customer").select(
            F.col("c_custkey").alias("task_id"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("speaker_id")
        )
        out = self._sql(SPEAKERS, listed=listed)
        merged = F.when(F.col("merged_text").isNotNull(), F.array(F.col("merged_text").cast("int")))
        return out.withColumn("merged_speakers", merged).drop("merged_text")

    @cached_property
    def transcripts(self) -> DataFrame:
        return self._sql(TRANSCRIPTS, conversations=self.raw("conversations"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.floor(F.col("vec_id") / 20).alias("task_id"), F.pmod("vec_id", F.lit(20)).cast("int").alias("idx"), "embedding", "label"
        )

    @cached_property
    def samples(self) -> DataFrame:
        events = self.raw("events").select("user_id", "ts", "event_id", "value")
        at = F.expr(SPARK_START)
        numbered = Ordered.of(events, ["user_id"], ["ts", "event_id"], at).row_number("__n").done()
        signed = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
        return numbered.select(
            F.col("user_id").alias("series_id"), (F.col("__n") - 1).cast("bigint").alias("pos"), (signed / 500).alias("value")
        )

    @cached_property
    def frames(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("series_id"), F.expr(SPARK_START).alias("t"), F.least(F.col("value") / 100, F.lit(1.0)).alias("prob")
        )

    @cached_property
    def meta(self) -> DataFrame:
        return self._sql(META, customer=self.raw("customer"))

    @cached_property
    def progress(self) -> DataFrame:
        return self._sql(PROGRESS, events=self.raw("events"))

    @cached_property
    def logs(self) -> DataFrame:
        return self._sql(LOGS, events=self.raw("events"))


def _duck(text: str, **views: str) -> str:
    for name, view in views.items():
        text = text.replace("{" + name + "}", view)
    return text.strip()


_NUMBERED = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS {kind})"

CTES = {
    "tasks": _duck(TASKS, orders="orders"),
    "steps": _duck(STEPS, lineitem="lineitem"),
    "step_updates": _duck(STEP_UPDATES, lineitem="lineitem"),
    "commands": _duck(COMMANDS, events="events"),
    "segments": (
        f"SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) - 1 AS INT) AS idx FROM "
        f"({_duck(SEGMENT_ROWS, events='events', start=DUCK_START)})"
    ),
    "speakers": _duck(SPEAKERS, listed="(SELECT c_custkey AS task_id, unnest([0, 1, 2, 3]) AS speaker_id FROM customer)"),
    "transcripts": _duck(TRANSCRIPTS, conversations="conversations"),
    "vectors": "SELECT vec_id // 20 AS task_id, CAST(vec_id % 20 AS INT) AS idx, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
    "samples": (
        f"SELECT user_id AS series_id, {_NUMBERED.format(kind='BIGINT')} AS pos, "
        "CASE WHEN event_id % 2 = 0 THEN value ELSE -value END / 500 AS value FROM events"
    ),
    "frames": f"SELECT user_id AS series_id, {DUCK_START} AS t, least(value / 100, CAST(1 AS DOUBLE)) AS prob FROM events",
    "meta": _duck(META, customer="customer"),
    "progress": _duck(PROGRESS, events="events"),
    "logs": _duck(LOGS, events="events"),
    "activity": _duck(ACTIVITY, events="events"),
}
