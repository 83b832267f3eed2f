"""Projects and their workflow steps: lookups, progress, summaries, status views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake import constants as K
from voxlake.functions import labels
from voxlake.functions.convert import text_or
from voxlake.plans.ordered import Ordered, parts

INTERACTION = [name for name, kind in K.PHASES if kind == "interaction"]
COMPUTATION = [name for name, kind in K.PHASES if kind == "computation"]
REVIEWS = [name for name in INTERACTION if name.startswith("awaiting_")]
STEP_FIELDS = ["task_order", "task_name", "phase", "task_group", "status", "attempt_count", "max_attempts"]


def _in(column: str, values: list[str]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def with_defaults(tasks: DataFrame, **defaults: str) -> DataFrame:
    """Missing or blank languages and engine get their defaults."""
    defaults = defaults or {"src_lang": "auto", "tgt_lang": "en", "tts_engine": "f5"}
    return tasks.withColumns({name: text_or(F.col(name), value) for name, value in defaults.items()})


def runnable_steps(steps: DataFrame, respect_attempts: bool = False) -> DataFrame:
    """Steps that may run.  Used-up attempts only matter when asked for."""
    out = steps.where(F.col("status").isin("pending", "failed", "queued"))
    return out.where(F.col("attempt_count") < F.col("max_attempts")) if respect_attempts else out


def next_step(steps: DataFrame, respect_attempts: bool = False) -> DataFrame:
    """The first runnable step of every project, in one pass."""
    fields = [c for c in STEP_FIELDS if c in steps.columns]
    return (
        runnable_steps(steps, respect_attempts)
        .groupBy("task_id")
        .agg(F.min_by(F.struct(*fields), F.struct("task_order", "task_name")).alias("step"))
        .select("task_id", "step.*")
    )


def workflow_progress(steps: DataFrame) -> DataFrame:
    """Counts by status, percent done without skipped steps, and the current step of each project."""
    def count(*states: str) -> Column:
        return F.count_if(F.col("status").isin(*states))

    active = F.col("status").isin("running", "queued")
    current = F.min_by(
        F.when(active, F.struct("task_name", "phase", "status")),
        F.when(active, F.struct("task_order", "task_name")),
    )
    counted = steps.groupBy("task_id").agg(
        F.count("*").alias("total"),
        count("completed").alias("completed"),
        count("failed").alias("failed"),
        count("skipped").alias("skipped"),
        count("running").alias("running"),
        count("pending", "queued").alias("pending"),
        current.alias("__current"),
    )
    done = F.try_divide(F.col("completed") * 100.0, F.col("total") - F.col("skipped"))
    return counted.select(
        "task_id", "total", "completed", "failed", "skipped", "running", "pending",
        F.round(F.coalesce(done, F.lit(0.0)), 1).alias("percent"),
        F.col("__current.task_name").alias("current_name"),
        F.col("__current.phase").alias("current_phase"),
        F.col("__current.status").alias("current_status"),
    )


PROGRESS_COUNTS = ["total", "completed", "failed", "skipped", "running", "pending"]


def enrich_tasks(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    """Every project with its step progress; projects without steps get zeros.

    Steps are aggregated before the join, so it meets at most one row per project.
    """
    return tasks.join(workflow_progress(steps), "task_id", "left").fillna(0, PROGRESS_COUNTS).fillna(0.0, ["percent"])


def nest_steps(tasks: DataFrame, steps: DataFrame, page_size: int = 1000) -> DataFrame:
    """Projects with their ordered step list, in pages so no list grows without bound."""
    numbered = Ordered.of(steps, ["task_id"], ["task_order", "task_name"]).row_number("__n").done()
    fields = [c for c in STEP_FIELDS if c in steps.columns]
    pages = (
        numbered.withColumn("page", parts(F.col("__n") - 1, page_size))
        .groupBy("task_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("__n", *fields))).alias("steps"))
        .withColumn("steps", F.transform("steps", lambda s: F.struct(*[s[f].alias(f) for f in fields])))
    )
    return tasks.join(pages, "task_id", "left").fillna(0, ["page"])


def attach_segments(tasks: DataFrame, segments: DataFrame, page_size: int = 1000) -> DataFrame:
    """Projects with their ordered segments, only in phases that show them; in pages like ``nest_steps``."""
    fields = [c for c in ("idx", "start_s", "end_s", "speaker_id", "original_text", "translated_text", "status")
              if c in segments.columns]
    shown = _in("phase", ["translating", "recomposing", "complete"])
    pages = (
        segments.join(tasks.where(shown).select("task_id"), "task_id", "left_semi")
        .withColumn("page", parts(F.col("idx"), page_size))
        .groupBy("task_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("segments"))
    )
    return tasks.join(pages, "task_id", "left").fillna(0, ["page"])


def task_summary(enriched: DataFrame) -> DataFrame:
    """The dashboard row of each project (input from ``enrich_tasks``)."""
    has_current = F.col("current_name").isNotNull() & (F.col("current_name") != "")
    return enriched.select(
        "task_id",
        F.coalesce(F.nullif("filename", F.lit("")), F.col("original_filename"), F.lit("Unknown")).alias("filename"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("phase", F.lit("unknown")).alias("phase"),
        F.coalesce("progress", F.lit(0.0)).alias("progress"),
        "created_at",
        "updated_at",
        F.coalesce("was_running_at_shutdown", F.lit(False)).alias("was_running_at_shutdown"),
        F.coalesce("resume_attempts", F.lit(0)).alias("resume_attempts"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        text_or(F.col("src_lang"), "auto").alias("src_lang"),
        text_or(F.col("tgt_lang"), "en").alias("tgt_lang"),
        F.coalesce("separate_audio", F.lit(False)).alias("separate_audio"),
        text_or(F.col("tts_engine"), "f5").alias("tts_engine"),
        F.when(has_current, F.struct(F.col("current_name").alias("name"), F.col("current_status").alias("status")))
        .alias("current_task"),
        F.struct(*PROGRESS_COUNTS, "percent").alias("workflow_summary"),
    )


def task_status(tasks: DataFrame) -> DataFrame:
    """The short status view of a transcript job; absent optional fields are NULL."""
    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in tasks.columns else F.lit(None).cast(kind).alias(name)

    return tasks.select(
        "task_id", "status",
        F.coalesce("progress", F.lit(0.0)).alias("progress"),
        F.coalesce(optional("message", "string"), F.lit("")).alias("message"),
        optional("original_text", "string"), optional("translated_text", "string"),
        optional("speaker_config", "string"), optional("segments", "string"),
        "filename", optional("duration", "double"),
    )


def recent_tasks(tasks: DataFrame, n: int = 50) -> DataFrame:
    """The n most recently updated projects, to the second; equal times by id."""
    return tasks.orderBy(F.date_trunc("second", "updated_at").desc(), F.col("task_id")).limit(n)


def interrupted_tasks(tasks: DataFrame, ordered: bool = True) -> DataFrame:
    """Projects that were at work when the system stopped, newest first.

    A NULL phase is not "outside" the finished phases, so such a row needs the flag.
    """
    working = F.col("status").isin("processing", "queued", "running")
    unfinished = ~F.col("phase").isin("complete", "failed", "cancelled")
    out = tasks.where((F.col("was_running_at_shutdown") == F.lit(True)) | (working & unfinished))
    return out.orderBy(F.col("updated_at").desc(), F.col("task_id")) if ordered else out


def resumption_flags(tasks: DataFrame) -> DataFrame:
    return tasks.withColumns({
        "can_resume": _in("status", ["paused", "failed", "error", "resuming"]),
        "can_restart": ~_in("status", ["processing", "queued"]),
        "was_interrupted": F.coalesce("was_running_at_shutdown", F.lit(False)),
    })


def task_action(tasks: DataFrame) -> DataFrame:
    """What a person can do with a project, and the progress shown for it."""
    waiting_words = ["awaiting_validation", "awaiting_translation_review"]
    waiting = _in("status", waiting_words) | _in("phase", waiting_words)
    interrupted = F.coalesce("was_running_at_shutdown", F.lit(False))
    resumable = (_in("status", ["paused", "failed", "error"]) | interrupted) & ~waiting
    watched = _in("status", ["processing", "queued", "running_translation"]) | waiting
    is_completed = _in("status", ["completed"])
    return tasks.withColumns({
        "action": F.when(is_completed, "completed")
        .when(resumable & interrupted, "resume")
        .when(resumable, "retry")
        .when(watched, "monitor")
        .otherwise("view"),
        "shown_progress": F.when(_in("status", ["awaiting_validation"]), 30.0)
        .when(is_completed, 100.0)
        .otherwise(F.coalesce("progress", F.lit(0.0))),
        "status_label": labels.status_label(F.col("status")),
        "status_class": labels.status_class(F.col("status")),
    })


def project_type(tasks: DataFrame) -> DataFrame:
    kind = (
        F.when(_in("source", ["youtube"]), "youtube")
        .when(F.coalesce("separate_audio", F.lit(False)), "music")
        .when(_in("tts_engine", ["f5", "fishspeech"]), "voice")
        .otherwise("video")
    )
    return tasks.withColumn("project_type", kind)


def review_stage(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Where a project should open, from its status, phase and what its segments hold."""
    def filled(name: str) -> Column:
        return F.bool_or(F.length(F.coalesce(name, F.lit(""))) > 0)

    held = segments.groupBy("task_id").agg(
        filled("audio_path").alias("__audio"),
        filled("translated_text").alias("__translated"),
        filled("original_text").alias("__original"),
    )
    phase = F.col("phase")
    def is_at(name: str, flag: str) -> Column:
        return F.coalesce(phase == name, F.lit(False)) | F.coalesce(flag, F.lit(False))

    review = (
        F.when(is_at("awaiting_audio_validation", "__audio"), "awaiting_audio_validation")
        .when(is_at("awaiting_translation_review", "__translated"), "awaiting_translation_review")
        .when(is_at("awaiting_transcription_review", "__original"), "awaiting_transcription_review")
        .otherwise("awaiting_speaker_validation")
    )
    waiting = _in("status", ["awaiting_validation"]) | _in("phase", [*REVIEWS, "complete"])
    stage = (
        F.when(_in("status", ["completed"]) | _in("phase", ["complete"]), "complete")
        .when(_in("status", ["failed", "error"]), "processing")
        .when(waiting, review)
        .when(_in("phase", COMPUTATION), "processing")
        .otherwise(phase)
    )
    return (
        tasks.join(held, "task_id", "left")
        .withColumn("review_stage", stage)
        .drop("__audio", "__translated", "__original")
    )


def phase_chain(tasks: DataFrame, short: bool = False, use_diarization: bool = True) -> DataFrame:
    """One row per project and phase with the phase's state.

    The full chain moves a computing phase that waits for validation to its review; the short
    chain is the one of plain transcripts, where phases about speakers can be left out.
    """
    if short:
        names = [p for p in K.TRANSCRIPT_PHASES if use_diarization or p not in K.SPEAKER_PHASES]
    else:
        names = [p for p, _ in K.PHASES]
    places = {name: i for i, name in enumerate(names)}
    last = len(names) - 1
    place = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(v) for kv in places.items() for v in kv]), F.col("phase")), F.lit(0)
    )
    if not short:
        waits = _in("phase", COMPUTATION[:-1]) & _in("status", ["awaiting_validation"])
        place = F.when(waits, place + 1).otherwise(place)
    place = F.when(_in("status", ["completed", "done"]), last).otherwise(place)

    is_review = _in("step_phase", REVIEWS)
    if short:
        attention, at_review = "skipped", _in("phase", ["awaiting_transcription_review"])
    else:
        attention, at_review = "attention", F.coalesce(F.col("phase").contains("awaiting"), F.lit(False))
    current = (
        F.when(_in("status", ["failed", "error"]), "failed")
        .when(_in("status", ["paused"]), "skipped")
        .when(is_review & (_in("status", ["awaiting_validation"]) | at_review), attention)
        .when(is_review, "running")
        .when(_in("status", ["completed"]) | _in("phase", ["complete"]), "completed")
        .otherwise("running")
    )
    state = (
        F.when(F.col("step_no") - 1 < F.col("__place"), "completed")
        .when(F.col("step_no") - 1 == F.col("__place"), current)
        .otherwise("pending")
    )
    kinds = dict(K.PHASES)
    steps = F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(n).alias("step_phase"), F.lit(kinds[n]).alias("kind"))
        for i, n in enumerate(names)
    ])
    return (
        tasks.withColumn("__place", place)
        .withColumn("__step", F.explode(steps))
        .select("*", "__step.*")
        .withColumn("state", state)
        .drop("__step", "__place")
    )


def validate_restarts(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Restart requests (task_id, from_phase) with their verdict and the state they lead to."""
    target = F.coalesce(F.nullif("from_phase", F.lit("")), F.lit("init"))
    valid = target.isin(*K.RESTART_PHASES)
    return (
        requests.join(tasks.select("task_id", F.lit(True).alias("__known")), "task_id", "left")
        .withColumn("accepted", valid & F.col("__known").isNotNull())
        .withColumn(
            "reason",
            F.when(F.col("__known").isNull(), "Task not found").when(~valid, "Invalid phase"),
        )
        .withColumn("new_phase", F.when(F.col("accepted"), target))
        .withColumn(
            "new_status",
            F.when(F.col("accepted"), F.when(target.isin(*INTERACTION), "awaiting_validation").otherwise("queued")),
        )
        .drop("__known")
    )


def delete_tasks(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given projects, dependents included."""
    gone = ids.select("task_id").distinct()
    return {name: df.join(gone, "task_id", "left_anti") for name, df in tables.items()}


def clear_running_flags(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("was_running_at_shutdown", F.lit(False))


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the schema's missing columns as NULL; what is there stays, extra columns too."""
    have = set(df.columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in have}
    return df.withColumns(missing) if missing else df


def phase_percent(
    df: DataFrame, phase: str = "phase", current: str = "current", total: str = "total", spans: list[tuple[str, int, int]] | None = None,
) -> DataFrame:
    """Overall percent of a project inside one computing phase; NULL for other phases.

    ``spans`` has (phase, start percent, width); by default those of the full workflow.
    """
    listed = K.PHASE_SPANS if spans is None else spans
    base = F.create_map(*[F.lit(v) for p, b, _ in listed for v in (p, b)])
    width = F.create_map(*[F.lit(v) for p, _, w in listed for v in (p, w)])
    share = F.coalesce(F.try_divide(F.col(current).cast("double"), F.col(total).cast("double")), F.lit(0.0))
    moved = (share * F.try_element_at(width, F.col(phase))).cast("int")
    return df.withColumn("overall_percent", F.try_element_at(base, F.col(phase)) + moved)
