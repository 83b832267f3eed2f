"""Queries about sampled signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.catalog.bindings import Tables
from voxlake.catalog.registry import query
from voxlake.functions.audio import ceil_div, clamp, db_to_gain
from voxlake.operators import signal as G

LENGTHS = "SELECT series_id, max(pos) + 1 AS length, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms FROM samples GROUP BY series_id"
LEVELS = {"lengths": LENGTHS}


def six(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names or ("value",)})


@query(
    "d04_series_quality",
    """SELECT *, duration < 3.0 AS too_short, duration > 15.0 AS too_long, peak < 0.1 AS quiet, peak > 0.99 AS clipped, std < 0.01 AS low_variance,
    CASE WHEN std < 0.001 THEN 'near_silent' WHEN peak > 1.05 THEN 'clipped' WHEN non_finite > 0 THEN 'non_finite' ELSE 'ok' END AS verdict
    FROM (SELECT s.series_id, count(*) AS samples, round(max(abs(value)), 6) AS peak, round(stddev_pop(value), 6) AS std, CAST(0 AS BIGINT) AS non_finite,
      any_value(sample_rate) AS sample_rate, CAST(count(*) AS DOUBLE) / any_value(sample_rate) AS duration
    FROM samples s LEFT JOIN meta m ON m.series_id = s.series_id GROUP BY s.series_id)""",
)
def _(t: Tables):
    return six(G.series_quality(t.samples, t.meta, max_peak=1.05), "peak", "std")


POWER = "SELECT *, avg(value * value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS power FROM samples"
GATED = """SELECT *, CASE WHEN max(CASE WHEN power > 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) > 0
  THEN 0.3 ELSE 1.0 END AS gain FROM powered"""


@query("e10_moving_power", "SELECT series_id, pos, round(power, 6) AS power FROM powered", powered=POWER)
def _(t: Tables):
    return six(G.moving_power(t.samples, 10).select("series_id", "pos", "power"), "power")


@query("e11_ducking_gain", "SELECT series_id, pos, CAST(gain AS DOUBLE) AS gain FROM gated", powered=POWER, gated=GATED)
def _(t: Tables):
    gated = G.ducking_gain(G.moving_power(t.samples, 10), 10, threshold=0.02)
    return gated.select("series_id", "pos", "gain")


@query("e11_speech_gate", "SELECT series_id, pos, round(power, 6) AS power, CAST(gain AS DOUBLE) AS gain FROM gated", powered=POWER, gated=GATED)
def _(t: Tables):
    return six(G.speech_gate(t.samples, 10, threshold=0.02).select("series_id", "pos", "power", "gain"), "power")


@query(
    "e12_edge_fade",
    """SELECT s.series_id, pos, round(value * CASE WHEN length >= 20 AND pos < 10 THEN pos / 9.0 WHEN length >= 20 AND pos >= length - 10 THEN (length - 1 - pos) / 9.0 ELSE 1 END, 6) AS value
    FROM samples s JOIN lengths l ON l.series_id = s.series_id""",
    **LEVELS,
)
def _(t: Tables):
    return six(G.edge_fade(t.samples, 10))


RESAMPLED = """SELECT series_id, j AS pos, a * (1 - (x - floor(x))) + b * (x - floor(x)) AS value FROM (
  SELECT p.*, s.value AS a, coalesce(n.value, s.value) AS b FROM (
    SELECT series_id, j, CASE WHEN j = m - 1 AND m > 1 THEN CAST(length - 1 AS DOUBLE) ELSE j * (CAST(length - 1 AS DOUBLE) / greatest(m - 1, 1)) END AS x
    FROM (SELECT *, unnest(range(m)) AS j FROM (SELECT *, CAST(trunc(length * CAST({ratio} AS DOUBLE)) AS BIGINT) AS m FROM lengths))) p
  JOIN samples s ON s.series_id = p.series_id AND s.pos = CAST(floor(p.x) AS BIGINT)
  LEFT JOIN samples n ON n.series_id = p.series_id AND n.pos = CAST(floor(p.x) AS BIGINT) + 1)"""


RESAMPLE = "SELECT series_id, pos, round(value, 6) AS value FROM resampled"


@query("e13_resample_up", RESAMPLE, resampled=RESAMPLED.format(ratio=3.0), **LEVELS)
def _(t: Tables):
    return six(G.resample_linear(t.samples, 3.0))


@query("e13_resample_down", RESAMPLE, resampled=RESAMPLED.format(ratio=0.4), **LEVELS)
def _(t: Tables):
    return six(G.resample_linear(t.samples, 0.4))


# Series are clips; three of them at a time share a timeline.
PLACED = "SELECT series_id // 3 AS task_id, series_id AS clip_id, (series_id % 3) * 1.5 AS start_s FROM lengths"
OVERLAID = """SELECT task_id, shift + pos AS pos, sum(value) AS value FROM samples s
  JOIN (SELECT *, CAST(trunc(start_s * 16) AS BIGINT) AS shift FROM placed) p ON p.clip_id = s.series_id GROUP BY 1, 2"""


def placements(t: Tables):
    return t.samples.groupBy("series_id").agg(F.count("*").alias("n")).select(
        F.floor(F.col("series_id") / 3).alias("task_id"), F.col("series_id").alias("clip_id"), (F.col("series_id") % 3 * 1.5).alias("start_s")
    )


@query("e14_overlay_add", "SELECT task_id, pos, round(value, 6) AS value FROM overlaid", placed=PLACED, overlaid=OVERLAID, **LEVELS)
def _(t: Tables):
    clips = t.samples.withColumnRenamed("series_id", "clip_id")
    return six(G.overlay_add(clips, placements(t), 16))


@query(
    "e14_overlay_dense",
    """SELECT g.task_id, g.pos, round(coalesce(value, 0), 6) AS value FROM (SELECT task_id, unnest(range(greatest(max(pos) + 1, 150))) AS pos FROM overlaid GROUP BY task_id) g
    LEFT JOIN overlaid o ON o.task_id = g.task_id AND o.pos = g.pos""",
    placed=PLACED, overlaid=OVERLAID, **LEVELS,
)
def _(t: Tables):
    clips = t.samples.withColumnRenamed("series_id", "clip_id")
    where = placements(t)
    timeline = where.select("task_id", F.lit(150).cast("bigint").alias("total_samples")).distinct()
    return six(G.overlay_add(clips, where, 16, dense=True, timeline=timeline))


# The overlaid clips with their gaps, judged as if these were filled with zeros to 150 samples at least.
FILLED = """SELECT g.task_id, g.pos, o.pos IS NOT NULL AS own, coalesce(value, 0) AS value
  FROM (SELECT task_id, unnest(range(greatest(max(pos) + 1, 150))) AS pos FROM overlaid GROUP BY task_id) g LEFT JOIN overlaid o ON o.task_id = g.task_id AND o.pos = g.pos"""
FILLED_POWER = "SELECT *, avg(value * value) OVER (PARTITION BY task_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS power FROM filled"
FILLED_GAIN = """SELECT *, CASE WHEN max(CASE WHEN power > 0.0201 THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) > 0
  THEN 0.3 ELSE 1.0 END AS gain FROM filled_power"""
GAPPED = {"placed": PLACED, "overlaid": OVERLAID, "filled": FILLED, "filled_power": FILLED_POWER, "filled_gain": FILLED_GAIN, **LEVELS}


def gapped(t: Tables):
    where = placements(t)
    timeline = where.select("task_id", F.lit(150).cast("bigint").alias("total_samples")).distinct()
    return G.overlay_add(t.samples.withColumnRenamed("series_id", "clip_id"), where, 16), timeline


@query("e10_sparse_power", "SELECT task_id, pos, round(power, 6) AS power FROM filled_power WHERE own", **GAPPED)
def _(t: Tables):
    samples, timeline = gapped(t)
    return six(G.sparse_power(samples, 20, timeline, ["task_id"]).select("task_id", "pos", "power"), "power")


@query("e11_sparse_gate", "SELECT task_id, pos, round(power, 6) AS power, CAST(gain AS DOUBLE) AS gain FROM filled_gain WHERE own", **GAPPED)
def _(t: Tables):
    samples, timeline = gapped(t)
    return six(G.sparse_gate(samples, 20, 0.0201, timeline=timeline, keys=["task_id"]).select("task_id", "pos", "power", "gain"), "power")


@query("e11_sparse_ducking", "SELECT task_id, pos FROM filled_gain WHERE gain < 1", **GAPPED)
def _(t: Tables):
    samples, timeline = gapped(t)
    return G.sparse_gate(samples, 20, 0.0201, timeline=timeline, keys=["task_id"], everywhere=True).where("gain < 1").select("task_id", "pos")


MIXED = """SELECT series_id, pos, sum(value * CASE track_id WHEN 0 THEN pow(10, -6 / CAST(20 AS DOUBLE)) WHEN 1 THEN pow(10, 3 / CAST(20 AS DOUBLE)) ELSE 1 END) AS value
  FROM (SELECT series_id // 3 AS series_id, series_id % 3 AS track_id, pos, value FROM samples) GROUP BY 1, 2"""


@query(
    "e15_mix_tracks",
    """SELECT m.series_id, pos, round(CASE WHEN peak > 1 THEN value / peak * 0.95 ELSE value END, 6) AS value FROM mixed m
    JOIN (SELECT series_id, max(abs(value)) AS peak FROM mixed GROUP BY 1) p ON p.series_id = m.series_id""",
    mixed=MIXED,
)
def _(t: Tables):
    tracks = t.samples.select(
        F.floor(F.col("series_id") / 3).alias("series_id"), (F.col("series_id") % 3).alias("track_id"), "pos", "value"
    )
    gains = t.spark.createDataFrame([(0, -6.0), (1, 3.0), (2, 0.0)], "track_id bigint, gain_db double")
    return six(G.mix_tracks(tracks, gains))


# A series speaks over a shortened copy of itself, looped.
BACKED = """SELECT s.series_id, s.pos, s.value * pow(10, -6 / CAST(20 AS DOUBLE)) + coalesce(b.value, 0) * pow(10, -20 / CAST(20 AS DOUBLE)) * s.gain AS value
  FROM gated s LEFT JOIN background_length l ON l.series_id = s.series_id LEFT JOIN resampled b
  ON b.series_id = s.series_id AND b.pos = s.pos % l.n"""


@query(
    "e16_mix_with_background",
    """SELECT m.series_id, pos, round(CASE WHEN peak > 0.99 THEN value / peak * 0.99 ELSE value END, 6) AS value FROM backed m
    JOIN (SELECT series_id, max(abs(value)) AS peak FROM backed GROUP BY 1) p ON p.series_id = m.series_id""",
    powered=POWER,
    gated=GATED.replace("0.02", "0.0001"),
    resampled=RESAMPLED.format(ratio=0.3),
    background_length="SELECT series_id, max(pos) + 1 AS n FROM resampled GROUP BY series_id",
    backed=BACKED,
    **LEVELS,
)
def _(t: Tables):
    background = G.resample_linear(t.samples, 0.3)
    return six(G.mix_with_background(t.samples, background, rate=100))


def _peak_sql(limit, target, quiet, boost):
    lift = f"WHEN peak < {quiet} AND peak > 0 THEN value / peak * {boost}" if quiet else ""
    return f"""SELECT s.series_id, pos, round(CASE WHEN peak > {limit} AND peak > 0 THEN value / peak * {target} {lift} ELSE value END, 6) AS value
      FROM scaled s JOIN (SELECT series_id, max(abs(value)) AS peak FROM scaled GROUP BY 1) p ON p.series_id = s.series_id"""


# Series are scaled apart so that loud, normal, quiet and very quiet ones occur.
SCALED = "SELECT series_id, pos, value * CASE series_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 0.1 ELSE 0.01 END AS value FROM samples"


def scaled(t: Tables):
    factor = F.element_at(F.array(*[F.lit(v) for v in (4.0, 1.0, 0.1, 0.01)]), (F.col("series_id") % 4 + 1).cast("int"))
    return t.samples.withColumn("value", F.col("value") * factor)


def _peak_query(rule: str, values: tuple) -> None:
    @query(f"e17_peak_{rule}", _peak_sql(*values), scaled=SCALED)
    def _(t: Tables):
        return six(G.peak_normalize(scaled(t), *values))


for _rule, _values in G.PEAK_RULES.items():
    _peak_query(_rule, _values)


@query(
    "e18_rms_normalize",
    """SELECT s.series_id, pos, round(CASE WHEN rms < 1e-10 THEN value ELSE (exp(2 * g) - 1) / (exp(2 * g) + 1) / 0.8 END, 6) AS value
    FROM (SELECT s.*, l.rms, value * pow(10, -14 / CAST(20 AS DOUBLE)) / rms * 0.8 AS g FROM samples s JOIN lengths l ON l.series_id = s.series_id) s""",
    **LEVELS,
)
def _(t: Tables):
    return six(G.rms_normalize(t.samples))


FITTED = """SELECT series_id, length / CAST(16 AS DOUBLE) AS current_s, (series_id % 9) * CAST(0.8 AS DOUBLE) AS target_s FROM lengths"""


def clips_to_fit(t: Tables):
    return G.series_length(t.samples).select(
        "series_id", (F.col("length") / 16).alias("current_s"), (F.col("series_id") % 9 * 0.8).alias("target_s")
    )


@query(
    "e19_fit_plan",
    """SELECT series_id, round(current_s, 6) AS current_s, round(target_s, 6) AS target_s, abs(current_s - target_s) > 0.05 AS stretch,
    CASE WHEN abs(current_s - target_s) > 0.05 AND target_s <> 0 THEN round(greatest(0.5, least(current_s / target_s, 2.0)), 6) END AS stretch_rate,
    CAST(trunc(CASE WHEN abs(current_s - target_s) > 0.05 THEN target_s ELSE current_s END * 16) AS BIGINT) AS target_samples FROM fitted""",
    fitted=FITTED, **LEVELS,
)
def _(t: Tables):
    return six(G.fit_plan(clips_to_fit(t), 16), "current_s", "target_s", "stretch_rate")


@query(
    "e19_trim_pad",
    """SELECT g.series_id, g.pos, round(coalesce(s.value, 0), 6) AS value FROM (SELECT series_id, unnest(range(n)) AS pos FROM (
      SELECT series_id, CAST(trunc(CASE WHEN abs(current_s - target_s) > 0.05 THEN target_s ELSE current_s END * 16) AS BIGINT) AS n FROM fitted)) g
    LEFT JOIN samples s ON s.series_id = g.series_id AND s.pos = g.pos""",
    fitted=FITTED, **LEVELS,
)
def _(t: Tables):
    return six(G.trim_pad(t.samples, G.fit_plan(clips_to_fit(t), 16)))


@query(
    "e20_trim_reference",
    """SELECT series_id, pos - f AS pos, round(value, 6) AS value, short FROM (
      SELECT s.*, CASE WHEN length / CAST(4 AS DOUBLE) > 15 THEN CAST(trunc(length * CAST(0.2 AS DOUBLE)) AS BIGINT) ELSE 0 END AS f,
        CASE WHEN length / CAST(4 AS DOUBLE) > 8 THEN 32 ELSE length END AS keep, length / CAST(4 AS DOUBLE) < 3 AS short
      FROM samples s JOIN lengths l ON l.series_id = s.series_id) WHERE pos >= f AND pos < f + keep""",
    **LEVELS,
)
def _(t: Tables):
    return six(G.trim_reference(t.samples, 4))


@query("e20_trim_reference_first", "SELECT series_id, pos, round(value, 6) AS value, length / CAST(4 AS DOUBLE) < 3 AS short FROM samples s JOIN lengths l USING (series_id) WHERE pos < 40", **LEVELS)
def _(t: Tables):
    return six(G.trim_reference(t.samples, 4, first_seconds=10.0))


@query(
    "e21_concat_offsets",
    """SELECT series_id, chunk_no, samples, CAST(coalesce(sum(samples + 4800) OVER (PARTITION BY series_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM (SELECT user_id AS series_id, event_id AS chunk_no, CAST(floor(value * 240) AS BIGINT) AS samples FROM events)""",
)
def _(t: Tables):
    chunks = t.raw("events").select(
        F.col("user_id").alias("series_id"), F.col("event_id").alias("chunk_no"), F.floor(F.col("value") * 240).alias("samples")
    )
    return G.concat_offsets(chunks, 4800)


@query(
    "h11_numeric_rules",
    """SELECT event_id, round(pow(10, (value - 50) / 20), 6) AS gain, round(greatest(0.5, least(value / 30, 2.0)), 6) AS clamped,
    CAST(trunc((value - 30) * 10) AS BIGINT) AS truncated, CAST(ceil(event_id / CAST(10 AS DOUBLE)) AS BIGINT) AS batches FROM events""",
)
def _(t: Tables):
    value = F.col("value")
    return t.raw("events").select(
        "event_id", F.round(db_to_gain(value - 50), 6).alias("gain"), F.round(clamp(value / 30, 0.5, 2.0), 6).alias("clamped"),
        ((value - 30) * 10).cast("bigint").alias("truncated"), ceil_div(F.col("event_id"), 10).alias("batches"),
    )
