"""State changes as joins: steps, commands, field updates, reviews, upserts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.operators.tasks import INTERACTION, REVIEWS
from voxlake.plans.ordered import Ordered

# The state each confirmation leads to.
CONFIRMATIONS = {
    "confirm_speakers": "transcribing",
    "confirm_transcription": "translating",
    "confirm_translation": "synthesizing",
    "confirm_audio": "recomposing",
}


def create_steps(tasks: DataFrame, definitions: list[dict], now: Column | None = None) -> DataFrame:
    """The step rows of new projects: order is the place in the list, all pending."""
    fields = "name: string, phase: string, group: string, max_attempts: int, inputs: string"
    rows = F.from_json(F.lit(_definitions_json(definitions)), f"array<struct<{fields}>>")
    stamp = F.current_timestamp() if now is None else now
    return (
        tasks.select("task_id", F.posexplode(rows).alias("task_order", "d"))
        .select(
            "task_id",
            F.col("d.name").alias("task_name"),
            "task_order",
            F.coalesce("d.phase", F.lit("init")).alias("phase"),
            F.col("d.group").alias("task_group"),
            F.lit("pending").alias("status"),
            stamp.alias("created_at"),
            F.lit(0).alias("attempt_count"),
            F.coalesce("d.max_attempts", F.lit(3)).alias("max_attempts"),
            F.col("d.inputs").alias("input_data"),
        )
    )


def _definitions_json(definitions: list[dict]) -> str:
    rows = []
    for d in definitions:
        inputs = d.get("inputs")
        rows.append({**d, "inputs": json.dumps(inputs) if inputs else None})
    return json.dumps(rows)


GIVEN_FIELDS = ["output_data", "checkpoint_data", "error_message", "error_traceback"]


def apply_step_updates(steps: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold an update log (task_id, task_name, seq, at, status, and any of GIVEN_FIELDS).

    A running update stamps the start and counts an attempt, a completed or skipped one stamps
    the end, and any other field changes only where an update gives it.
    """
    given = [c for c in GIVEN_FIELDS if c in updates.columns]

    def latest(name: str, when: Column | None = None) -> Column:
        given = F.col(name).isNotNull() if when is None else when
        return F.max_by(F.when(given, F.col(name)), F.when(given, F.col("seq")))

    running = F.col("status") == "running"
    ended = F.col("status").isin("completed", "skipped")
    # Empty text is no status.
    given_status = F.length(F.coalesce("status", F.lit(""))) > 0
    folded = updates.groupBy("task_id", "task_name").agg(
        latest("status", given_status).alias("__status"),
        latest("at", running).alias("__started"),
        latest("at", ended).alias("__ended"),
        F.count_if(running).cast("int").alias("__attempts"),
        *[latest(c).alias(f"__{c}") for c in given],
    )
    merged = steps.join(folded, ["task_id", "task_name"], "left")
    changes = {
        "status": F.coalesce("__status", "status"),
        "started_at": F.coalesce("__started", "started_at"),
        "completed_at": F.coalesce("__ended", "completed_at"),
        "attempt_count": F.col("attempt_count") + F.coalesce("__attempts", F.lit(0)),
        **{c: F.coalesce(f"__{c}", c) for c in given if c in steps.columns},
    }
    out = merged.withColumns({k: v for k, v in changes.items() if k in steps.columns})
    return out.select(*steps.columns)


def replay_commands(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """Every command (task_id, seq, command, from_phase) of a known project in its turn.

    Adds ``phase_before`` and ``status_before``, which earlier commands have left, ``phase_set``,
    ``status_set`` and ``running_set`` (NULL where the command leaves them), ``restarts`` and ``command_note``.
    ``start`` is refused while a person is asked or on a completed project, ``restart`` to an unknown phase;
    ``resume`` on a phase that waits for a person only restores the matching status.  Commands with
    one ``seq`` follow each other by name.

    Both states are read along one order, so the log is shuffled and sorted once; a project with very many
    commands is cut into chunks like any other group.
    """
    command = F.coalesce("command", F.lit(""))
    target = F.coalesce(F.nullif("from_phase", F.lit("")), F.lit("init"))
    restarts = (command == "restart") & target.isin(*K.RESTART_PHASES)
    confirmed = command.isin(*CONFIRMATIONS)
    confirm_map = F.create_map(*[F.lit(v) for kv in CONFIRMATIONS.items() for v in kv])
    first = tasks.select("task_id", F.coalesce("phase", F.lit("init")).alias("__phase"), F.coalesce("status", F.lit("pending")).alias("__status"))
    log = commands.select("task_id", "seq", "command", "from_phase").join(first, "task_id").withColumns({
        "restarts": restarts,
        "phase_set": F.when(restarts, target).when(confirmed, F.try_element_at(confirm_map, command)),
    })
    turns = Ordered.of(log, ["task_id"], ["seq", "command", "from_phase"]).last_before("phase_before", F.col("phase_set"))
    turns = turns.with_column("phase_before", F.coalesce("phase_before", "__phase"))
    phase = F.col("phase_before")
    waits = phase.isin(*INTERACTION)
    turns = turns.with_column(
        "status_set",
        F.when(command == "cancel", "cancelled")
        .when(command == "pause", "paused")
        .when((command == "resume") & (phase == "complete"), "completed")
        .when((command == "resume") & waits, "awaiting_validation")
        .when(command == "resume", "queued")
        .when(restarts & target.isin(*INTERACTION), "awaiting_validation")
        .when(restarts | confirmed, "queued"),
    )
    log = turns.last_before("status_before", F.col("status_set")).done().withColumn("status_before", F.coalesce("status_before", "__status"))
    asks = phase.isin(*REVIEWS) | (F.col("status_before") == "awaiting_validation")
    starts = (command == "start") & ~asks & (F.col("status_before") != "completed")
    refused = ((command == "start") & ~starts) | ((command == "restart") & ~restarts)
    # Queued work is picked up at once and then counts as running.
    runs = starts | ((command == "resume") & ~waits) | ((confirmed | restarts) & (F.col("phase_set") != "init"))
    stops = command.isin("cancel", "pause") | ((command == "resume") & waits) | (restarts & (target == "init"))
    return log.withColumns({
        "running_set": F.when(runs, True).when(stops, False),
        "command_note": F.when(refused, "refused").otherwise("applied"),
    }).drop("__phase", "__status")


def apply_commands(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """Projects after all their commands in the order of ``seq`` (see ``replay_commands``).

    ``command_note`` is that of the last command, NULL without one.  What no command has set stays as it was.
    """
    log = replay_commands(tasks, commands)
    turn = F.struct("seq", "command", "from_phase")
    last = lambda name: F.max_by(F.col(name), F.when(F.col(name).isNotNull(), turn))
    folded = log.groupBy("task_id").agg(
        last("phase_set").alias("__phase"),
        last("status_set").alias("__status"),
        last("running_set").alias("__running"),
        F.bool_or("restarts").alias("__restarted"),
        F.max_by("command_note", turn).alias("command_note"),
    )
    return (
        tasks.join(folded, "task_id", "left")
        .withColumns({
            "phase": F.coalesce("__phase", "phase"),
            "status": F.coalesce("__status", "status"),
            "was_running_at_shutdown": F.coalesce("__running", "was_running_at_shutdown"),
            "progress": F.when(F.col("__restarted"), 0.0).otherwise(F.col("progress")),
        })
        .select(*tasks.columns, "command_note")
    )


def merge_maps(base: Column, updates: Column) -> Column:
    """Key by key merge of two maps where the update wins."""
    base = F.coalesce(base, F.create_map().cast("map<string,string>"))
    updates = F.coalesce(updates, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(updates, k)), updates)


def update_tasks(tasks: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """Apply a field map per project (task_id, fields map<string,string>, seq).

    Names of table columns set the column (cast to its type, flags by their loose words); other
    names go into ``data``.  ``target_language`` and ``tgt_lang`` are the same field; where one update gives
    both, ``target_language`` counts.
    """
    from voxlake.functions.convert import to_bool

    direct = [c for c in tasks.columns if c not in ("task_id", "data", "updated_at")]
    other_name = F.col("name") == "target_language"
    flat = (
        updates.select("task_id", "seq", F.explode("fields").alias("name", "value"))
        .withColumn("turn", F.struct("seq", other_name.alias("other")))
        .withColumn("name", F.when(other_name, "tgt_lang").otherwise(F.col("name")))
        .groupBy("task_id", "name")
        .agg(F.max_by("value", "turn").alias("value"))
        .groupBy("task_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__fields"))
    )
    types = dict(tasks.dtypes)
    merged = tasks.join(flat, "task_id", "left")

    def field(name: str) -> Column:
        given = F.try_element_at("__fields", F.lit(name))
        value = to_bool(given, "write") if types[name] == "boolean" else given.try_cast(types[name])
        has = F.coalesce(F.map_contains_key("__fields", name), F.lit(False))
        return F.when(has, value).otherwise(F.col(name))

    rest = F.map_filter("__fields", lambda k, _: ~k.isin(*direct))
    stamp = F.current_timestamp() if now is None else now
    columns = {name: field(name) for name in direct}
    if "data" in tasks.columns:
        columns["data"] = F.when(F.col("__fields").isNotNull(), merge_maps(F.col("data"), rest)).otherwise(F.col("data"))
    if "updated_at" in tasks.columns:
        columns["updated_at"] = F.when(F.col("__fields").isNotNull(), stamp).otherwise(F.col("updated_at"))
    return merged.withColumns(columns).select(*tasks.columns)


def merge_state(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Shallow merge of state maps (task_id, state): keys of the update win, new projects are added."""
    left = base.select("task_id", F.col("state").alias("__base"))
    right = updates.select("task_id", F.col("state").alias("__new"))
    return left.join(right, "task_id", "full").select("task_id", merge_maps(F.col("__base"), F.col("__new")).alias("state"))


SEGMENT_FIELDS = [
    "start_s", "end_s", "speaker_id", "original_text", "translated_text", "audio_path", "status", "error",
]


def upsert_segments(base: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Insert or replace by (task_id, idx); the creation time of a known segment stays.

    ``updates`` may carry ``seq``; the last version of a segment wins.
    """
    keys = ["task_id", "idx"]
    fields = [c for c in SEGMENT_FIELDS if c in updates.columns and c in base.columns]
    order = F.col("seq") if "seq" in updates.columns else F.lit(0)
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("__new"))
    old = base.select(*keys, F.struct(*fields).alias("__old"), "created_at", "updated_at")
    merged = old.join(newest, keys, "full")
    is_new = F.col("__new").isNotNull()
    return merged.select(
        *keys,
        *[F.when(is_new, F.col(f"__new.{f}")).otherwise(F.col(f"__old.{f}")).alias(f) for f in fields],
        F.when(F.col("__old").isNull(), now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def save_review(segments: DataFrame, edits: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Segments after reviews that send full lists.

    ``reviewed`` has the projects whose review carried a list (even an empty one); their stored
    segments are replaced by ``edits``, all others stay.
    """
    given = reviewed.select("task_id").distinct()
    kept = segments.join(given, "task_id", "left_anti")
    new = edits.join(given, "task_id", "left_semi")
    return kept.unionByName(new, allowMissingColumns=True).select(*segments.columns)


def review_commands(reviews: DataFrame) -> DataFrame:
    """Commands for ``apply_commands`` from reviews (task_id, seq, review, save_only); saving alone moves nothing."""
    names = F.create_map(*[F.lit(v) for name in CONFIRMATIONS for v in (name.removeprefix("confirm_"), name)])
    return (
        reviews.where(~F.coalesce("save_only", F.lit(False)))
        .select("task_id", "seq", F.try_element_at(names, "review").alias("command"), F.lit(None).cast("string").alias("from_phase"))
        .where(F.col("command").isNotNull())
    )
