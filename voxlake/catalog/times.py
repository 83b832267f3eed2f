"""Queries about intervals in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.catalog.bindings import Tables
from voxlake.catalog.registry import query
from voxlake.operators import intervals as I
from voxlake.plans.lookup import attach


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# Frames are minutes apart here, so silences and pieces are in hours.
HOUR = 3600.0
SPEECH = """SELECT series_id, greatest(0, s - 0.3) AS start_s, e + 0.3 AS end_s FROM (
  SELECT series_id, island, min(t) AS s, max(t) AS e FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY t) AS island FROM (
      SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t) < 21600 THEN 0 ELSE 1 END AS fresh
      FROM frames WHERE prob >= 0.15))
  GROUP BY series_id, island) WHERE e - s >= 0.1"""


@query(
    "e03_speech_segments",
    """SELECT series_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM (
      SELECT series_id, start_s + 90000 * k AS start_s, CASE WHEN k = n - 1 THEN end_s ELSE start_s + 90000 * (k + 1) END AS end_s
      FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, CASE WHEN end_s - start_s > 108000
        THEN CAST(floor((end_s - start_s - 18000) / 90000) + 1 AS BIGINT) ELSE 1 END AS n FROM speech))
      UNION ALL SELECT series_id, 0, duration FROM meta WHERE duration > 0 AND series_id NOT IN (SELECT series_id FROM speech))""",
    speech=SPEECH,
)
def _(t: Tables):
    out = I.speech_segments(
        t.frames, t.meta, min_silence=6 * HOUR, max_len=30 * HOUR, step=25 * HOUR, min_tail=5 * HOUR
    )
    return rounded(out, "start_s", "end_s")


@query(
    "e04_split_long",
    """SELECT series_id, event_id, CAST(k AS INT) AS piece_no, round(start_s + 25 * k, 6) AS start_s,
    round(CASE WHEN k = n - 1 THEN end_s ELSE start_s + 25 * (k + 1) END, 6) AS end_s
    FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT task_id AS series_id, event_id, start_s, end_s,
      CASE WHEN end_s - start_s > 30 THEN CAST(floor((end_s - start_s - 5) / 25) + 1 AS BIGINT) ELSE 1 END AS n FROM segments))""",
)
def _(t: Tables):
    intervals = t.segments.select(F.col("task_id").alias("series_id"), "event_id", "start_s", "end_s")
    return rounded(I.split_long(intervals), "start_s", "end_s")


@query(
    "e05_pack_blocks",
    """SELECT series_id, block_no, round(min(start_s), 6) AS start_s, round(last(end_s ORDER BY n), 6) AS end_s, CAST(count(*) AS BIGINT) AS intervals FROM (
      WITH RECURSIVE folded AS (
        SELECT series_id, n, start_s, end_s, d AS total, CAST(0 AS BIGINT) AS block_no FROM numbered WHERE n = 1
        UNION ALL
        SELECT x.series_id, x.n, x.start_s, x.end_s, CASE WHEN f.total + x.d > 60 THEN x.d ELSE f.total + x.d END,
          f.block_no + CASE WHEN f.total + x.d > 60 THEN 1 ELSE 0 END
        FROM folded f JOIN numbered x ON x.series_id = f.series_id AND x.n = f.n + 1)
      SELECT * FROM folded) GROUP BY series_id, block_no""",
    numbered="""SELECT task_id AS series_id, start_s, end_s, end_s - start_s AS d,
      row_number() OVER (PARTITION BY task_id ORDER BY start_s, end_s) AS n FROM segments""",
)
def _(t: Tables):
    return rounded(I.pack_blocks(t.intervals, 60.0), "start_s", "end_s")


@query(
    "e06_sliding_chunks",
    """SELECT series_id, CAST(k AS INT) AS chunk_no, round(k * CAST(29 AS DOUBLE), 6) AS start_s, round(least(k * CAST(29 AS DOUBLE) + 30, duration), 6) AS end_s
    FROM (SELECT *, unnest(range(CASE WHEN duration <= 0 THEN 0 WHEN duration <= 30 THEN 1 ELSE CAST(ceil((duration - 30) / 29) + 1 AS BIGINT) END)) AS k FROM meta)""",
)
def _(t: Tables):
    return rounded(I.sliding_chunks(t.meta).select("series_id", "chunk_no", "start_s", "end_s"), "start_s", "end_s")


@query(
    "e22_rebase_times",
    """SELECT s.task_id, s.idx, round(s.value + b.base, 6) AS start_s, round(s.value + 1 + b.base, 6) AS end_s
    FROM (SELECT *, end_s - start_s AS value, idx // 8 AS block_no FROM segments) s
    JOIN (SELECT task_id, idx // 8 AS block_no, min(start_s) AS base FROM segments GROUP BY 1, 2) b ON b.task_id = s.task_id AND b.block_no = s.block_no""",
)
def _(t: Tables):
    block = F.floor(F.col("idx") / 8).alias("block_no")
    length = F.col("end_s") - F.col("start_s")
    local = t.segments.select("task_id", "idx", block, length.alias("start_s"), (length + 1).alias("end_s"))
    blocks = t.segments.groupBy("task_id", block).agg(F.min("start_s").alias("start_s"))
    out = I.rebase_times(local, blocks, ["task_id", "block_no"])
    return rounded(out.select("task_id", "idx", "start_s", "end_s"), "start_s", "end_s")


# Intervals anywhere in their series, and some past its ends; every 40th is a good part of it long.
SLICES = """SELECT user_id AS series_id, event_id, CAST(event_id * 7919 % (2 * n + 20) - 10 AS DOUBLE) / 2 AS start_s,
  CAST(event_id * 7919 % (2 * n + 20) - 10 AS DOUBLE) / 2 + CASE WHEN event_id % 40 = 0 THEN n / 3.0D ELSE value / 10 END AS end_s
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {events})"""


@query(
    "c10_slice_samples",
    """SELECT s.series_id, i.event_id, s.pos, s.pos - i.low AS slice_pos, round(s.value, 6) AS value FROM samples s
    JOIN (SELECT series_id, event_id, greatest(0, CAST(trunc(start_s * 2) AS BIGINT)) AS low, CAST(trunc(end_s * 2) AS BIGINT) AS high FROM slices) i
    ON i.series_id = s.series_id AND s.pos >= i.low AND s.pos < i.high""",
    slices=SLICES.replace("{events}", "events").replace("3.0D", "CAST(3 AS DOUBLE)"),
)
def _(t: Tables):
    events = t.raw("events")
    sizes = events.groupBy("user_id").agg(F.count("*").alias("n"))
    counted = attach(events, sizes, ["user_id"])
    intervals = t.spark.sql(SLICES.replace("(SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {events})", "{counted}"), counted=counted)
    out = I.slice_samples(t.samples, intervals, 2)
    return rounded(out.select("series_id", "event_id", "pos", "slice_pos", "value"), "value")
