"""Sampled signals as rows (series_id, pos, value): levels, gates, fades, resampling, mixing.

Level statistics are one aggregate per series attached back by ``attach``; frames run inside
blocks with a margin; new positions come from the rows that produce them.  No operator needs a
whole series in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions.audio import clamp, db_to_gain, sample_at, soft_clip
from voxlake.plans.grid import BLOCK, dense_positions, framed, with_margin
from voxlake.plans.lookup import attach
from voxlake.plans.ordered import Ordered

SERIES = ["series_id"]

# Fixed values: (limit, target, quiet below, boost to) of the peak rules.
PEAK_RULES = {
    "speech_track": (0.99, 0.99, None, None),
    "reference": (0.95, 0.95, None, None),
    "mix": (1.0, 0.95, None, None),
    "engine": (0.95, 0.95, 0.1, 0.5),
    "synthesis": (0.95, 0.95, 0.01, 0.5),
    "always": (0.0, 0.95, None, None),
}


def series_length(samples: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return samples.groupBy(*keys).agg((F.max("pos") + 1).alias("length"))


def series_quality(samples: DataFrame, meta: DataFrame, keys: list[str] = SERIES, max_peak: float = 10.0) -> DataFrame:
    """Length, peak, population deviation and non-finite values of each series, with flags and a verdict."""
    value = F.col("value")
    broken = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    stats = samples.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.max(F.abs(value)).alias("peak"),
        F.stddev_pop(value).alias("std"),
        F.count_if(broken).alias("non_finite"),
    )
    out = stats.join(meta.select(*keys, "sample_rate"), keys, "left").withColumn(
        "duration", F.col("samples") / F.col("sample_rate")
    )
    return out.withColumns({
        "too_short": F.col("duration") < 3.0,
        "too_long": F.col("duration") > 15.0,
        "quiet": F.col("peak") < 0.1,
        "clipped": F.col("peak") > 0.99,
        "low_variance": F.col("std") < 0.01,
        # NaN compares as larger than any number here, and must not count as clipped.
        "verdict": F.when(F.col("std") < 0.001, "near_silent")
        .when((F.col("peak") > max_peak) & ~F.isnan("peak"), "clipped")
        .when(F.col("non_finite") > 0, "non_finite")
        .otherwise("ok"),
    })


def moving_power(samples: DataFrame, window: int, keys: list[str] = SERIES) -> DataFrame:
    """Mean square over [pos - w/2, pos + w/2)."""
    half = window // 2
    return framed(samples, keys, "pos", half, half - 1, power=lambda w: F.avg(F.col("value") * F.col("value")).over(w))


def ducking_gain(
    power: DataFrame, window: int, threshold: float = 1e-4, low: float = 0.3, keys: list[str] = SERIES
) -> DataFrame:
    """Gain ``low`` wherever the power passes ``threshold`` within [pos - w/5, pos + w/5), else 1."""
    reach = window // 5
    loud = F.when(F.col("power") > threshold, 1).otherwise(0)
    return framed(
        power, keys, "pos", reach, reach - 1,
        gain=lambda w: F.when(F.max(loud).over(w) > 0, F.lit(low)).otherwise(F.lit(1.0)),
    )


def speech_gate(
    samples: DataFrame, window: int, threshold: float = 1e-4, low: float = 0.3, keys: list[str] = SERIES
) -> DataFrame:
    """``moving_power`` and ``ducking_gain`` together: one margin for both frames, so one shuffle and sort."""
    half, reach = window // 2, window // 5
    rows = with_margin(samples, keys, "pos", half + reach, half + reach - 2)
    by = Window.partitionBy(*keys, BLOCK).orderBy("pos")
    power = F.avg(F.col("value") * F.col("value")).over(by.rowsBetween(-half, half - 1))
    loud = F.max(F.when(F.col("power") > threshold, 1).otherwise(0)).over(by.rowsBetween(-reach, reach - 1))
    return (
        rows.withColumn("power", power)
        .withColumn("gain", F.when(loud > 0, F.lit(low)).otherwise(F.lit(1.0)))
        .where("__own")
        .drop(BLOCK, "__own")
    )


def timeline_length(samples: DataFrame, timeline: DataFrame | None, keys: list[str] = SERIES) -> DataFrame:
    """``length`` of each series: to its last sample, and at least the ``total_samples`` of ``timeline``."""
    lengths = series_length(samples, keys)
    if timeline is None:
        return lengths
    return lengths.join(timeline.select(*keys, "total_samples"), keys, "full").select(
        *keys, F.greatest("length", "total_samples").alias("length")
    )


def _mean_square(half: int, keys: list[str]):
    """Mean square over [pos - half, pos + half) of a timeline whose zeros may be missing, from rows with ``length``."""
    frame = Window.partitionBy(*keys, BLOCK).orderBy("pos").rangeBetween(-half, half - 1)
    places = F.least(F.col("pos") + half, F.col("length")) - F.greatest(F.col("pos") - half, F.lit(0))
    return F.sum(F.col("value") * F.col("value")).over(frame) / places


def sparse_power(samples: DataFrame, window: int, timeline: DataFrame | None = None, keys: list[str] = SERIES) -> DataFrame:
    """``moving_power`` of a signal whose zeros are left out, as the filled signal has it at the samples.

    A position has one sample at most. Series are as long as ``timeline_length`` tells. Nothing is filled: frames go
    by position.
    """
    half = window // 2
    rows = attach(samples, timeline_length(samples, timeline, keys), keys)
    rows = with_margin(rows, keys, "pos", half, half - 1).withColumn("power", _mean_square(half, keys))
    return rows.where("__own").drop(BLOCK, "__own", "length")


def _fill(samples: DataFrame, reach: int, keys: list[str]) -> DataFrame:
    """Samples (with ``length``) and the zeros within ``reach`` of one, each from the sample that is next to it."""
    if reach < 1:
        return samples.select(*keys, "length", "pos", "value", F.lit(False).alias("filled"))
    place, by = F.col("pos"), Window.partitionBy(*keys, BLOCK).orderBy("pos")
    near = with_margin(samples, keys, "pos", 2 * reach, reach).withColumns({
        "__last": F.max("pos").over(by.rangeBetween(-2 * reach, -1)),
        "__next": F.min("pos").over(by.rangeBetween(1, reach)),
    })
    # What the sample before fills behind itself is not filled again.
    low = F.least(place, F.greatest(place - reach, F.col("__last") + reach + 1, F.lit(0)))
    high = F.greatest(place, F.least(place + reach, F.col("__next") - 1, F.col("length") - 1))
    return near.where("__own").withColumn("__at", F.explode(F.sequence(low, high))).select(
        *keys, "length", F.col("__at").alias("pos"),
        F.when(F.col("__at") == place, F.col("value")).otherwise(F.lit(0.0)).alias("value"),
        (F.col("__at") != place).alias("filled"),
    )


def fill_near(samples: DataFrame, reach: int, timeline: DataFrame | None = None, keys: list[str] = SERIES) -> DataFrame:
    """Samples and zeros at the empty positions within ``reach`` of one (``filled``), inside ``timeline_length``.

    One sample makes 2 * ``reach`` rows at most, however wide the gaps are.
    """
    return _fill(attach(samples, timeline_length(samples, timeline, keys), keys), reach, keys).drop("length")


def sparse_gate(
    samples: DataFrame, window: int, threshold: float = 1e-4, low: float = 0.3, timeline: DataFrame | None = None,
    keys: list[str] = SERIES, everywhere: bool = False,
) -> DataFrame:
    """``speech_gate`` of a signal whose zeros are left out: ``pos, value, power, gain`` as the filled signal has them.

    At the samples, or ``everywhere`` that the gain can be low: all positions left out then have gain 1 and power 0.
    Empty positions can be loud too, so those near samples are filled; ``threshold`` must not be negative.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    half, reach = window // 2, window // 5
    rows = attach(samples, timeline_length(samples, timeline, keys), keys)
    rows = with_margin(_fill(rows, half + reach if everywhere else reach, keys), keys, "pos", half + reach, half + reach - 2)
    near = Window.partitionBy(*keys, BLOCK).orderBy("pos").rangeBetween(-reach, reach - 1)
    loud = F.max(F.when(F.col("power") > threshold, 1).otherwise(0)).over(near)
    gated = rows.withColumn("power", _mean_square(half, keys)).withColumn("gain", F.when(loud > 0, F.lit(low)).otherwise(F.lit(1.0)))
    shown = F.col("__own") if everywhere else F.col("__own") & ~F.col("filled")
    return gated.where(shown).select(*keys, "pos", "value", "power", "gain")


def edge_fade(samples: DataFrame, n: int, keys: list[str] = SERIES) -> DataFrame:
    """Linear fade over the first and last n samples; series shorter than 2n are left alone."""
    out = attach(samples, series_length(samples, keys), keys)
    from_end = F.col("length") - 1 - F.col("pos")
    nearest = F.least(F.col("pos"), from_end)
    factor = F.when((F.col("length") >= 2 * n) & (nearest < n), nearest / F.lit(max(n - 1, 1))).otherwise(F.lit(1.0))
    return out.withColumn("value", F.col("value") * factor).drop("length")


def resample_linear(samples: DataFrame, ratio: float, keys: list[str] = SERIES) -> DataFrame:
    """Linear interpolation at int(length * ratio) evenly spaced places from the first to the last sample.

    Each source sample produces the new positions that fall between it and its neighbour, so a
    long series needs no list of all its positions.
    """
    pairs = framed(samples, keys, "pos", 0, 1, __next=lambda w: F.last("value").over(w))
    out = attach(pairs, series_length(samples, keys), keys).withColumn(
        "__new", (F.col("length") * F.lit(float(ratio))).cast("bigint")
    ).where(F.col("__new") > 0)
    step = (F.col("length") - 1) / F.greatest(F.col("__new") - 1, F.lit(1))
    last = F.col("__new") - 1
    low = F.greatest(F.floor(F.try_divide(F.col("pos").cast("double"), step)) - 1, F.lit(0))
    high = F.least(F.ceil(F.try_divide(F.col("pos") + 1.0, step)) + 1, last)
    # A series of one sample has no step; its only place is repeated.
    low, high = F.coalesce(low, F.lit(0)), F.coalesce(high, last)
    candidates = F.when(low <= high, F.sequence(low, high))
    place = F.when((F.col("__j") == last) & (last > 0), (F.col("length") - 1).cast("double")).otherwise(F.col("__j") * step)
    out = out.withColumn("__j", F.explode(candidates)).withColumn("__at", place).where(F.floor("__at") == F.col("pos"))
    part = F.col("__at") - F.floor("__at")
    return out.withColumns({
        "value": F.col("value") * (1 - part) + F.col("__next") * part,
        "pos": F.col("__j"),
    }).drop("__next", "__new", "__j", "__at", "length")


def overlay_add(
    clips: DataFrame,
    placements: DataFrame,
    rate: int = K.MIX_RATE,
    dense: bool = False,
    timeline: DataFrame | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Clips (clip_id, pos, value) added up on their projects' timelines (task_id, clip_id, start_s).

    ``dense`` fills the gaps with zeros, up to the ``total_samples`` of ``timeline`` where given
    and at least to the end of the last clip.
    """
    by = keys or ["task_id"]
    placed = clips.join(placements.select(*by, "clip_id", sample_at(F.col("start_s"), rate).alias("__at")), "clip_id")
    summed = placed.groupBy(*by, (F.col("__at") + F.col("pos")).alias("pos")).agg(F.sum("value").alias("value"))
    if not dense:
        return summed
    grid = dense_positions(timeline_length(summed, timeline, by), by, "length").select(*by, "pos")
    return grid.join(summed, [*by, "pos"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def _levels(samples: DataFrame, keys: list[str]) -> DataFrame:
    value = F.col("value")
    return samples.groupBy(*keys).agg(F.max(F.abs(value)).alias("__peak"), F.sqrt(F.avg(value * value)).alias("__rms"))


def peak_normalize(
    samples: DataFrame,
    limit: float = 0.99,
    target: float = 0.99,
    quiet: float | None = None,
    boost: float | None = None,
    keys: list[str] = SERIES,
) -> DataFrame:
    """Scale series whose peak passes ``limit`` to ``target``; lift those below ``quiet`` to ``boost``."""
    peak = F.col("__peak")
    gain = F.when((peak > limit) & (peak > 0), F.lit(target) / peak)
    if quiet is not None:
        gain = gain.when((peak < quiet) & (peak > 0), F.lit(boost) / peak)
    out = attach(samples, _levels(samples, keys).select(*keys, "__peak"), keys)
    return out.withColumn("value", F.col("value") * gain.otherwise(F.lit(1.0))).drop("__peak")


def rms_normalize(samples: DataFrame, target_db: float = -14.0, keys: list[str] = SERIES) -> DataFrame:
    """Bring each series to a loudness and soft-clip it; silence is left alone."""
    out = attach(samples, _levels(samples, keys).select(*keys, "__rms"), keys)
    rms = F.col("__rms")
    loud = soft_clip(F.col("value") * (db_to_gain(F.lit(float(target_db))) / rms))
    return out.withColumn("value", F.when(rms < 1e-10, F.col("value")).otherwise(loud)).drop("__rms")


def mix_tracks(tracks: DataFrame, gains: DataFrame, keys: list[str] = SERIES, track: str = "track_id") -> DataFrame:
    """Tracks (series, track, pos, value) summed with their gains in dB (track, gain_db), then limited."""
    gained = attach(tracks, gains.select(track, db_to_gain(F.col("gain_db")).alias("__gain")), [track], "inner")
    mixed = gained.groupBy(*keys, "pos").agg(F.sum(F.col("value") * F.col("__gain")).alias("value"))
    limit, target, _, _ = PEAK_RULES["mix"]
    return peak_normalize(mixed, limit, target, keys=keys)


def mix_with_background(
    speech: DataFrame,
    background: DataFrame | None,
    rate: int = K.MIX_RATE,
    speech_db: float = -6.0,
    background_db: float = -20.0,
    keys: list[str] = SERIES,
) -> DataFrame:
    """Speech over a looped or cut background that ducks under it, limited to 0.99."""
    limit, target, _, _ = PEAK_RULES["speech_track"]
    speech_gain, back_gain = 10 ** (speech_db / 20), 10 ** (background_db / 20)
    if background is None:
        return peak_normalize(speech.withColumn("value", F.col("value") * speech_gain), limit, target, keys=keys)
    window = rate // 10
    gated = speech_gate(speech, window, keys=keys)
    looped = attach(gated, series_length(background, keys), keys).withColumn("__bg", F.pmod("pos", "length"))
    under = background.select(*keys, F.col("pos").alias("__bg"), F.col("value").alias("__under"))
    mixed = looped.join(under, [*keys, "__bg"], "left").select(
        *keys, "pos",
        (F.col("value") * speech_gain + F.coalesce("__under", F.lit(0.0)) * back_gain * F.col("gain")).alias("value"),
    )
    return peak_normalize(mixed, limit, target, keys=keys)


def fit_plan(clips: DataFrame, rate: int = K.SYNTH_RATE, tolerance: float = 0.05) -> DataFrame:
    """Speed and length a clip (current_s, target_s) needs to fill its segment; NULL speed means leave it."""
    far = F.abs(F.col("current_s") - F.col("target_s")) > tolerance
    raw = F.try_divide(F.col("current_s"), F.col("target_s"))
    rate_used = clamp(F.when(raw <= 0, 1.0).otherwise(raw), 0.5, 2.0)
    return clips.withColumns({
        "stretch": far,
        "stretch_rate": F.when(far & raw.isNotNull(), rate_used),
        "target_samples": F.when(far, sample_at(F.col("target_s"), rate)).otherwise(sample_at(F.col("current_s"), rate)),
    })


def trim_pad(samples: DataFrame, lengths: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Cut series to ``target_samples`` (one row per series in ``lengths``) or fill them with zeros."""
    wanted = lengths.select(*keys, "target_samples")
    kept = attach(samples, wanted, keys, "inner").where(F.col("pos") < F.col("target_samples"))
    have = wanted.join(series_length(samples, keys), keys, "left").withColumns({
        "__from": F.coalesce("length", F.lit(0)),
        "__missing": F.greatest(F.col("target_samples") - F.coalesce("length", F.lit(0)), F.lit(0)),
    })
    padding = dense_positions(have, keys, "__missing").select(
        *keys, (F.col("__from") + F.col("pos")).alias("pos"), F.lit(0.0).alias("value")
    )
    return kept.select(*keys, "pos", "value").unionByName(padding)


def trim_reference(samples: DataFrame, rate: int = K.SYNTH_RATE, keys: list[str] = SERIES, first_seconds: float | None = None) -> DataFrame:
    """Reference samples cut to a useful length.

    Above 15 s: 8 s from 20 % on; above 8 s: the first 8 s; ``short`` marks those below 3 s.  With
    ``first_seconds`` simply that much from the start.
    """
    seconds = F.col("length") / rate
    if first_seconds is not None:
        start, keep = F.lit(0), F.lit(int(first_seconds * rate))
    else:
        start = F.when(seconds > 15.0, (F.col("length") * F.lit(0.2)).cast("bigint")).otherwise(F.lit(0))
        keep = F.when(seconds > 8.0, F.lit(8 * rate)).otherwise(F.col("length"))
    out = attach(samples, series_length(samples, keys), keys)
    return (
        out.where((F.col("pos") >= start) & (F.col("pos") < start + keep))
        .withColumns({"pos": F.col("pos") - start, "short": seconds < 3.0})
        .drop("length")
    )


def concat_offsets(chunks: DataFrame, gap_samples: int, keys: list[str] = SERIES, order: str = "chunk_no") -> DataFrame:
    """Start of each chunk (with its ``samples``) when they are joined with a silence between them."""
    rows = Ordered.of(chunks, keys, [order])
    return rows.running_sum("offset", F.col("samples") + gap_samples, before=True).done()
