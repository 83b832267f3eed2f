"""Speaker configuration: labels, merges, removals, samples, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import labels
from voxlake.functions.text import strip
from voxlake.plans.ordered import Ordered, oversized
from voxlake.plans.spread import spread, spread_even

SPEAKER = ["task_id", "speaker_id"]
TURN_ROWS = 1 << 18
CONFIG_FIELDS = [
    "name", "action", "include", "merged_into", "merged_speakers", "sample_path", "total_duration", "intervention_count",
]


def _config(speakers: DataFrame, suffix: str, *fields: str) -> DataFrame:
    """The asked fields of a configuration under names that cannot clash."""
    return speakers.select("task_id", F.col("speaker_id").alias(f"__id{suffix}"), *[
        F.col(f).alias(f"__{f}{suffix}") for f in fields if f in speakers.columns
    ])


def _join(segments: DataFrame, config: DataFrame, suffix: str, on: Column, rows: int | None = None) -> DataFrame:
    """``rows``: how many there are on both sides, where that is known; they are dealt to tasks by it."""
    left = segments.withColumn(f"__id{suffix}", on)
    if rows is not None:
        left = spread(left, ["task_id", f"__id{suffix}"], rows)
    return left.join(config, ["task_id", f"__id{suffix}"], "left").drop(f"__id{suffix}")


def with_speaker_name(segments: DataFrame, speakers: DataFrame, blank_is_missing: bool = False) -> DataFrame:
    """Configured name, else 'Speaker n'."""
    out = _join(segments, _config(speakers, "", "name"), "", F.col("speaker_id"))
    name = F.nullif(F.trim("__name"), F.lit("")) if blank_is_missing else F.col("__name")
    return out.withColumn("speaker_name", F.coalesce(name, labels.default_name(F.col("speaker_id")))).drop("__name")


def drop_removed(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments whose speaker is not marked 'remove'; unknown speakers stay."""
    removed = speakers.where(F.col("action") == "remove").select(*SPEAKER)
    return segments.join(removed, SPEAKER, "left_anti")


def merge_map(speakers: DataFrame, rows: int | None = None) -> DataFrame:
    """(task_id, speaker_id, master): own ``merged_into`` and masters' ``merged_speakers``, later speakers last.

    ``rows``: how many speakers there are; counted where it is not given.
    """
    own = speakers.where(F.col("merged_into").isNotNull()).select(
        *SPEAKER, F.col("merged_into").alias("master"), F.struct(F.col("speaker_id").alias("a"), F.lit(0).alias("b")).alias("at")
    )
    listed = speakers.select(
        "task_id",
        F.explode("merged_speakers").alias("member"),
        F.col("speaker_id").alias("master"),
    ).select(
        "task_id",
        F.col("member").cast("int").alias("speaker_id"),
        "master",
        F.struct(F.col("master").alias("a"), F.lit(1).alias("b")).alias("at"),
    )
    merged = spread(own.unionByName(listed), SPEAKER, speakers.count() if rows is None else rows)
    return merged.groupBy(*SPEAKER).agg(F.max_by("master", "at").alias("master"))


def resolve_speakers(speakers: DataFrame) -> DataFrame:
    """What merging means for each configured or merged speaker.

    (task_id, speaker_id, effective_speaker_id, action, voice_sample).  All look-ups between
    speakers happen here, on the small side, so segments only need one join.
    """
    rows = speakers.count()
    merges = merge_map(speakers, rows).withColumnRenamed("master", "__master")
    ids = spread(speakers.select(*SPEAKER).unionByName(merges.select(*SPEAKER)), SPEAKER, rows).distinct()
    out = ids.join(merges, SPEAKER, "left").withColumn("effective_speaker_id", F.coalesce("__master", "speaker_id"))
    fields = [c for c in ("action", "sample_path") if c in speakers.columns]
    out = _join(out, _config(speakers, "e", *fields), "e", F.col("effective_speaker_id"), rows)
    if "sample_path" in fields:
        out = _join(out, _config(speakers, "w", "sample_path"), "w", F.col("speaker_id"), rows)
        samples = [F.nullif(c, F.lit("")) for c in ("__sample_pathe", "__sample_pathw")]
    else:
        samples = [F.lit(None).cast("string")]
    return out.select(
        *SPEAKER, "effective_speaker_id", F.coalesce("__actione", F.lit("dub")).alias("action"),
        F.coalesce(*samples).alias("voice_sample"),
    )


def _resolved(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    out = spread_even(segments, SPEAKER).join(resolve_speakers(speakers), SPEAKER, "left")
    # A speaker nobody configured stays itself.
    return out.withColumns({
        "effective_speaker_id": F.coalesce("effective_speaker_id", "speaker_id"),
        "action": F.coalesce("action", F.lit("dub")),
    })


def effective_speakers(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Add the speaker after one hop of merging, and that speaker's action ('dub' where none is set)."""
    return _resolved(segments, speakers).drop("voice_sample")


def apply_speaker_edits(segments: DataFrame, speakers: DataFrame, mode: str = "merge_first") -> DataFrame:
    """Segments left after merges and removals, under their final speaker.

    ``filter_first`` drops a segment by its own speaker's action or include flag, then maps to
    the master and drops it if the master is removed.  ``merge_first`` maps first and only
    looks at the final speaker's action.
    """
    if mode == "merge_first":
        final = resolve_speakers(speakers).select(
            *SPEAKER, F.col("effective_speaker_id").alias("__final"), (F.col("action") == "remove").alias("__dropped")
        )
    elif mode == "filter_first":
        masters = _config(speakers, "m", "action")
        own = F.coalesce(F.col("action") == "remove", F.lit(False)) | F.coalesce(F.col("include") == F.lit(False), F.lit(False))
        final = _join(speakers, masters, "m", F.coalesce("merged_into", "speaker_id")).select(
            *SPEAKER,
            F.coalesce("merged_into", "speaker_id").alias("__final"),
            (own | F.coalesce(F.col("__actionm") == "remove", F.lit(False))).alias("__dropped"),
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = segments.join(final, SPEAKER, "left").where(~F.coalesce("__dropped", F.lit(False)))
    return out.withColumn("speaker_id", F.coalesce("__final", "speaker_id")).select(*segments.columns)


def voice_sample(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Sample of the effective speaker, else of the own speaker, else NULL."""
    return _resolved(segments, speakers)


def speaker_stats(segments: DataFrame) -> DataFrame:
    """Speaking time and segment count with the default configuration of each speaker."""
    return (
        segments.groupBy(*SPEAKER)
        .agg(
            F.round(F.sum(F.col("end_s") - F.col("start_s")), 2).alias("total_duration"),
            F.count("*").alias("intervention_count"),
        )
        .withColumn("name", labels.default_name(F.col("speaker_id")))
        .withColumn("action", F.lit("dub"))
    )


def speaker_count(segments: DataFrame) -> DataFrame:
    """Distinct speakers per project (two-level, so no set is held per project)."""
    pairs = segments.groupBy(*SPEAKER).agg(F.lit(1).alias("one"))
    return pairs.groupBy("task_id").agg(F.count("speaker_id").alias("num_speakers"))


def merge_speaker_config(old: DataFrame, new: DataFrame) -> DataFrame:
    """Exactly the speakers of the new configuration; a field it leaves out keeps its old value.

    Speakers are keyed by the text ``speaker_key``; keys that start with '_' are not speakers.
    """
    keys = ["task_id", "speaker_key"]
    fields = [c for c in CONFIG_FIELDS if c in new.columns or c in old.columns]
    before = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields if c in old.columns])
    out = new.where(~F.col("speaker_key").startswith("_")).join(before, keys, "left")

    def pick(name: str) -> Column:
        sides = [F.col(c) for c, there in ((name, name in new.columns), (f"__{name}", name in old.columns)) if there]
        return F.coalesce(*sides).alias(name)

    return out.select(*keys, *[pick(c) for c in fields])


def speakers_from_groups(groups: DataFrame, toggles: DataFrame) -> DataFrame:
    """Speaker configuration from merge groups (task_id, group_no, ids) and cards (task_id, speaker_id, name, is_dub).

    The first id of a group is its master; the others are merged into it and removed.
    """
    members = groups.select("task_id", "group_no", F.col("ids")[0].alias("master"), F.posexplode("ids").alias("place", "speaker_id"))
    merged = (
        members.where(F.col("place") > 0)
        .groupBy(*SPEAKER)
        .agg(F.max_by("master", F.struct("group_no", "place")).alias("merged_into"))
    )
    masters = (
        groups.select("task_id", F.col("ids")[0].alias("speaker_id"), "group_no", F.slice("ids", F.lit(2), F.greatest(F.size("ids"), F.lit(1))).alias("rest"))
        .groupBy(*SPEAKER)
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "rest"))), lambda g: g["rest"])).alias("merged_speakers"))
    )
    return (
        toggles.join(merged, SPEAKER, "left")
        .join(masters, SPEAKER, "left")
        .select(
            *SPEAKER,
            "name",
            F.when(F.col("merged_into").isNotNull(), "remove")
            .when(F.coalesce("is_dub", F.lit(False)), "dub")
            .otherwise("remove")
            .alias("action"),
            "merged_into",
            F.coalesce("merged_speakers", F.array().cast("array<int>")).alias("merged_speakers"),
        )
    )


def select_reference(segments: DataFrame, budget: float = 15.0, gap: float = 0.5, salts: int = 256) -> DataFrame:
    """Longest segments of each speaker until ``budget`` seconds are reached; the crossing one is in.

    ``offset_s`` is where the segment starts in the joined sample, with ``gap`` seconds after each.
    A speaker with very many segments is thinned first: a segment that already has ``budget``
    seconds of longer ones in its own slice of the speaker cannot be among the chosen.
    """
    rows = segments.withColumn("duration", F.col("end_s") - F.col("start_s"))
    longest = [F.col("duration").desc(), F.col("idx")]

    def before(by: list[str]) -> Column:
        frame = Window.partitionBy(*by).orderBy(*longest).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("duration").over(frame), F.lit(0.0))

    if oversized(rows, SPEAKER):
        sliced = rows.withColumn("__slice", F.pmod(F.xxhash64("idx"), F.lit(salts)))
        rows = sliced.withColumn("__before", before([*SPEAKER, "__slice"])).where(F.col("__before") < budget).drop("__slice")
    rank = F.row_number().over(Window.partitionBy(*SPEAKER).orderBy(*longest))
    return (
        rows.withColumn("__before", before(SPEAKER))
        .withColumn("rank", rank)
        .where(F.col("__before") < budget)
        .withColumn("offset_s", F.col("__before") + (F.col("rank") - 1) * gap)
        .drop("__before")
    )


def _join_pieces(pieces: DataFrame) -> DataFrame:
    """Turns from their pieces, one per chunk; a part takes pieces until it has TURN_ROWS segments."""
    turn = Window.partitionBy("task_id", "turn_no")
    earlier = F.sum("segments").over(turn.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumns({
        "part": F.floor(F.coalesce(earlier, F.lit(0)) / TURN_ROWS).cast("int"),
        "start_s": F.min("start_s").over(turn),
        "__last": F.max_by("__last", "__last.at").over(turn),
        "segments": F.sum("segments").over(turn),
    })
    texts = F.array_sort(F.collect_list(F.struct("__chunk", "text")))
    return placed.groupBy("task_id", "turn_no", "part").agg(
        *[F.first(c).alias(c) for c in ("speaker_id", "start_s", "__last", "segments")],
        F.array_join(F.transform(texts, lambda p: p["text"]), " ").alias("text"),
    )


def speaker_turns(segments: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """Runs of segments of one speaker in time order, with their joined text.

    A turn of more than TURN_ROWS segments comes in several ``part`` rows, each with its share of
    the text and all with the times of the whole turn; every other turn is part 0.
    """
    rows = Ordered.of(segments, ["task_id"], ["start_s", "idx"]).previous("__prev", F.struct("speaker_id"))
    same = F.col("__prev.speaker_id").eqNullSafe(F.col("speaker_id"))
    rows = rows.with_column("__new", F.when(F.col("__prev").isNull() | ~same, 1).otherwise(0))
    rows = rows.running_sum("__turn", F.col("__new"))
    at = F.struct("start_s", "idx")
    text = F.coalesce(strip(F.col("original_text")), F.lit(""))
    piece = ["task_id", "turn_no", *(["__chunk"] if rows.cut else [])]
    pieces = (
        rows.df.withColumn("turn_no", (F.col("__turn") - 1).cast("int"))
        .groupBy(*piece)
        .agg(
            F.first("speaker_id").alias("speaker_id"),
            F.min("start_s").alias("start_s"),
            F.max_by(F.struct("end_s", at.alias("at")), at).alias("__last"),
            F.count("*").alias("segments"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("start_s", "idx", text.alias("t")))), lambda s: s["t"]), " "
            ).alias("text"),
        )
    )
    if rows.cut:
        pieces = _join_pieces(pieces)
    else:
        pieces = pieces.withColumn("part", F.lit(0))
    out = pieces.withColumn("end_s", F.col("__last.end_s"))
    fields = ["task_id", "turn_no", "part", "speaker_id", "start_s", "end_s", "segments", "text"]
    if speakers is None:
        return out.select(*fields)
    return with_speaker_name(out.select(*fields), speakers)
