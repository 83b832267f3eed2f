"""Segments of recordings: review merges, synthesis planning, batches, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions import text as X
from voxlake.functions.audio import ceil_div, sample_at
from voxlake.functions.convert import file_stem, file_suffix
from voxlake.operators.speakers import voice_sample
from voxlake.plans.ordered import Ordered, parts

PART_ROWS = 10_000


def synthesis_plan(segments: DataFrame, speakers: DataFrame, rate: int = K.SYNTH_RATE) -> DataFrame:
    """Why a segment stays silent, or 'speak'; and how many samples it must fill."""
    out = voice_sample(segments, speakers)
    words = X.text_class(F.col("translated_text"))
    return out.withColumns({
        "reason": F.when(F.col("action") == "remove", "removed")
        .when(words == "empty", "empty_text")
        .when(F.col("voice_sample").isNull(), "no_sample")
        .when(words == "symbols", "no_words")
        .otherwise("speak"),
        "target_samples": sample_at(F.col("end_s") - F.col("start_s"), rate),
    })


def assembly_inputs(segments: DataFrame) -> DataFrame:
    """Finished segments that have audio, with a flag for silent ones."""
    return (
        segments.where((F.col("status") == "completed") & (F.length("audio_path") > 0))
        .withColumn("is_silent", F.length(F.coalesce("error", F.lit(""))) > 0)
    )


def assembly_verdict(segments: DataFrame) -> DataFrame:
    """Whether a project can be put together: ok, all_silent, all_failed or none_created."""
    done = F.col("status") == "completed"
    counts = segments.groupBy("task_id").agg(
        F.count("*").alias("segments"),
        F.count_if(done & (F.length("audio_path") > 0)).alias("usable"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(done & (F.length("error") > 0)).alias("silent"),
    )
    verdict = (
        F.when((F.col("usable") == 0) & (F.col("failed") > 0), "all_failed")
        .when(F.col("usable") == 0, "none_created")
        .when(F.col("silent") == F.col("segments"), "all_silent")
        .otherwise("ok")
    )
    return counts.withColumn("verdict", verdict)


def phase_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("task_id").agg(
        F.count_if(F.length("translated_text") > 0).alias("translated"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ).withColumn("success", (F.col("failed") == 0) & (F.col("completed") > 0))


def all_translated(segments: DataFrame) -> DataFrame:
    return segments.groupBy("task_id").agg(
        F.bool_and(F.length(F.coalesce("translated_text", F.lit(""))) > 0).alias("all_translated")
    )


def timeline_length(segments: DataFrame, rate: int = K.MIX_RATE) -> DataFrame:
    """Samples of each project's timeline; audio that hangs over its end (``samples``) extends it."""
    end = F.max(F.col("end_s"))
    planned = sample_at(end, rate)
    if "samples" in segments.columns:
        planned = F.greatest(planned, F.max(sample_at(F.col("start_s"), rate) + F.col("samples")))
    return segments.groupBy("task_id").agg(end.alias("max_end"), planned.alias("total_samples"))


def merge_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Review edits by (task_id, idx): the last edit of a segment wins, field by field.

    An edit (task_id, idx, seq, original_text, translated_text, has_original, has_translated)
    sets a text only where its has_ flag is true; a set NULL overwrites.  Where segments share an
    index, the first of them (by time, then text) changes.
    """
    def last(name: str, flag: str) -> Column:
        given = F.coalesce(flag, F.lit(False))
        return F.max_by(F.when(given, F.struct(F.col(name).alias("v"))), F.when(given, F.col("seq")))

    folded = edits.groupBy("task_id", "idx").agg(
        last("original_text", "has_original").alias("__o"), last("translated_text", "has_translated").alias("__t")
    )
    turn = [c for c in ("start_s", "end_s", "original_text", "translated_text") if c in segments.columns]
    first = F.row_number().over(Window.partitionBy("task_id", "idx").orderBy(*turn)) == 1

    def edited(change: str, text: str) -> Column:
        return F.when(F.col("__first") & F.col(change).isNotNull(), F.col(f"{change}.v")).otherwise(F.col(text))

    return (
        segments.join(folded, ["task_id", "idx"], "left")
        .withColumn("__first", first)
        .withColumns({"original_text": edited("__o", "original_text"), "translated_text": edited("__t", "translated_text")})
        .select(*segments.columns)
    )


def lookup_segment(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Asked segments (task_id, asked) by their ``idx``, else by their 0-based place in the list."""
    fields = [c for c in segments.columns if c != "task_id"]
    placed = Ordered.of(segments, ["task_id"], ["idx"]).row_number("__n").done()
    by_idx = segments.select("task_id", F.col("idx").alias("asked"), F.struct(*fields).alias("__by_idx"))
    by_place = placed.select("task_id", (F.col("__n") - 1).cast("int").alias("asked"), F.struct(*fields).alias("__by_place"))
    found = keys.join(by_idx, ["task_id", "asked"], "left").join(by_place, ["task_id", "asked"], "left")
    hit = F.coalesce("__by_idx", "__by_place")
    return found.select(
        "task_id", "asked",
        F.when(F.col("__by_idx").isNotNull(), "idx").when(F.col("__by_place").isNotNull(), "place").alias("matched_by"),
        *[hit[f].alias(f) for f in fields],
    )


def assign_batches(df: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """1-based batch numbers of ``size`` rows in order, and the number of batches of the group."""
    rows = Ordered.of(df, by, order).row_number("__n").total("__count", F.count(F.lit(1)))
    return rows.done().withColumns({
        "batch_no": (F.floor((F.col("__n") - 1) / size) + 1).cast("int"),
        "total_batches": ceil_div(F.col("__count"), size).cast("int"),
    }).drop("__n", "__count")


def joined_text(
    df: DataFrame, value: Column, by: list[str], order: str = "idx", sep: str = " ", part_rows: int = PART_ROWS
) -> DataFrame:
    """``value`` joined in order, in parts of ``part_rows`` positions so that no text grows without bound.

    A recording of up to ``part_rows`` segments has one part, number 0.
    """
    return (
        df.withColumn("part", parts(F.col(order), part_rows))
        .groupBy(*by, "part")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("t")))).alias("__lines"))
        .withColumn("text", F.array_join(F.transform("__lines", lambda l: l["t"]), sep))
        .drop("__lines")
    )


def concat_text(segments: DataFrame, sep: str = " ", part_rows: int = PART_ROWS) -> DataFrame:
    return joined_text(segments, F.col("original_text"), ["task_id"], "idx", sep, part_rows)


def derived_paths(segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """File names that follow from a segment, its speaker and its project."""
    source = F.coalesce(F.nullif("filename", F.lit("")), F.col("original_filename"), F.lit("video.mp4"))
    suffix = F.coalesce(F.nullif(file_suffix(F.col("output_path")), F.lit("")), F.lit(".mp4"))
    named = tasks.select("task_id", F.concat(F.lit("dubbed_"), file_stem(source), suffix).alias("download_name"))
    task = F.col("task_id").cast("string")
    wav = F.format_string("segment_%04d.wav", "idx")
    return segments.join(named, "task_id", "left").withColumns({
        "segment_file": wav,
        "segment_url": F.concat(F.lit("/temp_chunks/"), task, F.lit("/"), wav),
        "sample_url": F.concat(
            F.lit("/temp_chunks/"), task, F.lit("/speaker_samples/speaker_"), F.col("speaker_id").cast("string"), F.lit("_sample.wav")
        ),
        "output_dir": F.concat(F.lit("outputs/"), task),
    })


def preview_bounds(segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Where a segment's preview comes from and the slice to play."""
    master = F.coalesce("master_audio", "file_path") if "master_audio" in tasks.columns else F.col("file_path")
    return segments.join(tasks.select("task_id", master.alias("__master")), "task_id", "left").withColumns({
        "preview_source": F.coalesce(F.nullif("audio_path", F.lit("")), F.col("__master")),
        "preview_start": F.round("start_s", 3),
        "preview_duration": F.round(F.greatest(F.lit(0.1), F.col("end_s") - F.col("start_s")), 3),
    }).drop("__master")


def log_tail(logs: DataFrame, n: int = 100, order: str = "seq") -> DataFrame:
    """The last n entries of each project.  Spark limits inside the map side before it shuffles."""
    from pyspark.sql import Window

    newest = Window.partitionBy("task_id").orderBy(F.col(order).desc())
    return logs.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n).drop("__n")


def finalize_status(segments: DataFrame) -> DataFrame:
    """Status and error text after synthesis, from ``critical_error``, ``engine_error`` and ``reason``."""
    silent = F.coalesce(F.col("reason") != "speak", F.lit(False)) | F.col("engine_error").isNotNull()
    soft = F.when(F.col("engine_error").isNotNull(), X.error_text(F.col("engine_error"), "synthesis")).otherwise(
        F.nullif("error", F.lit(""))
    )
    return segments.withColumns({
        "status": F.when(F.col("critical_error").isNotNull(), "failed").otherwise("completed"),
        "error": F.when(F.col("critical_error").isNotNull(), X.error_text(F.col("critical_error"), "critical"))
        .when(silent, F.coalesce(soft, F.lit(K.SILENT_TEXT)))
        .otherwise(soft),
    })
