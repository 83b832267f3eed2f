"""Queries about segments and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.catalog.bindings import Tables
from voxlake.catalog.registry import query
from voxlake.functions.labels import default_voice
from voxlake.operators import lifecycle as L
from voxlake.operators import segments as S
from voxlake.operators import speakers as P
from voxlake.operators.intervals import long_enough
from voxlake.sources import export as X

STRIP = r"E' \n\t\r'"

# Master of each merged speaker: own entry first, then the lists of masters, the later speaker last.
MERGES = """SELECT task_id, speaker_id, last(master ORDER BY a, b) AS master FROM (
  SELECT task_id, speaker_id, merged_into AS master, speaker_id AS a, 0 AS b FROM speakers WHERE merged_into IS NOT NULL
  UNION ALL SELECT task_id, CAST(merged_text AS INT), speaker_id, speaker_id, 1 FROM speakers WHERE merged_text IS NOT NULL
) GROUP BY task_id, speaker_id"""
EFFECTIVE = """SELECT s.*, coalesce(m.master, s.speaker_id) AS effective_speaker_id, coalesce(c.action, 'dub') AS action
FROM segments s LEFT JOIN merges m ON m.task_id = s.task_id AND m.speaker_id = s.speaker_id
LEFT JOIN speakers c ON c.task_id = s.task_id AND c.speaker_id = coalesce(m.master, s.speaker_id)"""
SAMPLED = """SELECT e.*, coalesce(nullif(a.sample_path, ''), nullif(b.sample_path, '')) AS voice_sample FROM effective e
LEFT JOIN speakers a ON a.task_id = e.task_id AND a.speaker_id = e.effective_speaker_id
LEFT JOIN speakers b ON b.task_id = e.task_id AND b.speaker_id = e.speaker_id"""
PLAN = rf"""SELECT *, CASE WHEN action = 'remove' THEN 'removed' WHEN coalesce(trim(translated_text, {STRIP}), '') = '' THEN 'empty_text'
  WHEN voice_sample IS NULL THEN 'no_sample'
  WHEN trim(regexp_replace(translated_text, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), {STRIP}) = '' THEN 'no_words' ELSE 'speak' END AS reason,
  CAST(trunc((end_s - start_s) * 24000) AS BIGINT) AS target_samples FROM sampled"""
TURN_ROWS = """SELECT *, sum(is_new) OVER (PARTITION BY task_id ORDER BY start_s, idx) - 1 AS turn_no FROM (
  SELECT *, CASE WHEN lag(speaker_id) OVER (PARTITION BY task_id ORDER BY start_s, idx) = speaker_id THEN 0 ELSE 1 END AS is_new FROM segments)"""
TURNS = f"""SELECT r.task_id, CAST(turn_no AS INT) AS turn_no, 0 AS part, any_value(r.speaker_id) AS speaker_id,
  min(start_s) AS start_s, last(end_s ORDER BY start_s, idx) AS end_s, count(*) AS segments,
  string_agg(coalesce(trim(original_text, {STRIP}), ''), ' ' ORDER BY start_s, idx) AS text
FROM turn_rows r GROUP BY r.task_id, turn_no"""
NAMED_TURNS = """SELECT t.*, coalesce(p.name, 'Speaker ' || (t.speaker_id + 1)) AS speaker_name FROM turns t
LEFT JOIN speakers p ON p.task_id = t.task_id AND p.speaker_id = t.speaker_id"""
TURN_VIEWS = {"turn_rows": TURN_ROWS, "turns": TURNS, "named_turns": NAMED_TURNS}
EDITS = """SELECT task_id, CAST(idx // 2 AS INT) AS idx, event_id AS seq,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('o', CAST(event_id AS STRING)) END AS original_text,
  concat('t', CAST(event_id AS STRING)) AS translated_text,
  event_id % 4 <> 1 AS has_original, event_id % 5 <> 1 AS has_translated FROM segments"""


def six(name: str):
    return F.round(F.col(name), 6).alias(name)


@query(
    "a05_markdown_blocks",
    """SELECT task_id, turn_no, 0 AS part, '**' || speaker_name || E'**:\\n' || text || E'\\n' AS value FROM named_turns
    UNION ALL SELECT DISTINCT task_id, -1, 0, E'# Transcription Export\\n\\n*Generated on today*\\n\\n---\\n' FROM named_turns""",
    **TURN_VIEWS,
)
def _(t: Tables):
    return X.markdown_document(P.speaker_turns(t.segments, t.speakers), F.lit("today"))


@query(
    "a06_json_documents",
    """SELECT task_id, 'turn' AS kind, CAST(turn_no AS BIGINT) AS place, speaker_name AS label, text, round(start_s, 6) AS start_s FROM named_turns
    UNION ALL SELECT task_id, 'segment', CAST(idx AS BIGINT), CAST(speaker_id AS VARCHAR), original_text, round(start_s, 6) FROM segments""",
    **TURN_VIEWS,
)
def _(t: Tables):
    documents = X.transcript_documents(t.segments, t.speakers)
    turns = documents.select("task_id", F.posexplode("grouped_segments").alias("place", "s")).select(
        "task_id", F.lit("turn").alias("kind"), F.col("place").cast("bigint").alias("place"),
        F.col("s.speaker_name").alias("label"), "s.text", F.round("s.start_s", 6).alias("start_s"),
    )
    raw = documents.select("task_id", F.explode("raw_segments").alias("s")).select(
        "task_id", F.lit("segment").alias("kind"), F.col("s.idx").cast("bigint").alias("place"),
        F.col("s.speaker_id").cast("string").alias("label"), F.col("s.original_text").alias("text"), F.round("s.start_s", 6).alias("start_s"),
    )
    return turns.unionByName(raw)


@query(
    "a07_transcript_lines",
    """SELECT task_id, CAST(0 AS INT) AS part, string_agg('[' || name || ']: ' || original_text, E'\\n' ORDER BY idx) AS original_text,
    string_agg('[' || name || ']: ' || translated_text, E'\\n' ORDER BY idx) AS translated_text
    FROM (SELECT s.*, coalesce(p.name, 'Speaker ' || (s.speaker_id + 1)) AS name FROM segments s
      LEFT JOIN speakers p ON p.task_id = s.task_id AND p.speaker_id = s.speaker_id) GROUP BY task_id""",
)
def _(t: Tables):
    return X.transcript_lines(t.segments, t.speakers)


@query(
    "a07_conversation_lines",
    """SELECT task_id, CAST(0 AS INT) AS part, string_agg('[' || name || ']: ' || original_text, E'\\n' ORDER BY idx) AS original_text
    FROM (SELECT s.*, coalesce(p.name, 'Speaker ' || (s.speaker_id + 1)) AS name FROM transcripts s
      LEFT JOIN speakers p ON p.task_id = s.task_id AND p.speaker_id = s.speaker_id) GROUP BY task_id""",
)
def _(t: Tables):
    return X.transcript_lines(t.transcripts, t.speakers)


@query(
    "a08_bilingual_lines",
    """SELECT task_id, CAST(0 AS INT) AS part, string_agg('[' || format('{:.1f}', round(start_s, 1)) || 's] ' || coalesce(original_text, '') || ' -> '
    || coalesce(translated_text, ''), E'\\n' ORDER BY idx) AS text FROM segments GROUP BY task_id""",
)
def _(t: Tables):
    return X.bilingual_lines(t.segments)


@query(
    "a10_upsert_segments",
    """SELECT coalesce(b.task_id, u.task_id) AS task_id, coalesce(b.idx, u.idx) AS idx,
    CASE WHEN u.task_id IS NULL THEN b.original_text ELSE u.original_text END AS original_text,
    CASE WHEN u.task_id IS NULL THEN b.status ELSE u.status END AS status,
    CASE WHEN b.task_id IS NULL THEN 'now' ELSE 'before' END AS created_at, CASE WHEN u.task_id IS NULL THEN 'before' ELSE 'now' END AS updated_at
    FROM segments b FULL JOIN (SELECT task_id, CAST(idx * 3 // 2 AS INT) AS idx, last(original_text ORDER BY event_id) AS original_text,
      last(status ORDER BY event_id) AS status FROM segments GROUP BY 1, 2) u ON u.task_id = b.task_id AND u.idx = b.idx""",
)
def _(t: Tables):
    base = t.segments.withColumns({"created_at": F.lit("before"), "updated_at": F.lit("before")})
    updates = t.segments.withColumn("idx", F.floor(F.col("idx") * 3 / 2).cast("int")).withColumn("seq", F.col("event_id"))
    # last() in SQL skips no NULL, and neither does the struct of the newest version.
    return L.upsert_segments(base, updates, F.lit("now")).select("task_id", "idx", "original_text", "status", "created_at", "updated_at")


@query(
    "b14_synthesis_plan",
    "SELECT task_id, idx, effective_speaker_id, voice_sample, reason, target_samples FROM planned",
    merges=MERGES, effective=EFFECTIVE, sampled=SAMPLED, planned=PLAN,
)
def _(t: Tables):
    return S.synthesis_plan(t.segments, t.speakers).select(
        "task_id", "idx", "effective_speaker_id", "voice_sample", "reason", "target_samples"
    )


@query(
    "b15_minimum_length",
    "SELECT task_id, idx, round(end_s - start_s, 6) AS duration FROM segments WHERE trunc(end_s * 16000) - trunc(start_s * 16000) >= 1600",
)
def _(t: Tables):
    return long_enough(t.segments, 16000, min_samples=1600).select("task_id", "idx", F.round(F.col("end_s") - F.col("start_s"), 6).alias("duration"))


@query(
    "b16_assembly_inputs",
    """SELECT task_id, idx, audio_path, length(coalesce(error, '')) > 0 AS is_silent FROM segments
    WHERE status = 'completed' AND length(audio_path) > 0""",
)
def _(t: Tables):
    return S.assembly_inputs(t.segments).select("task_id", "idx", "audio_path", "is_silent")


@query(
    "c03_drop_removed",
    """SELECT s.task_id, s.idx, s.speaker_id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM speakers p
    WHERE p.task_id = s.task_id AND p.speaker_id = s.speaker_id AND p.action = 'remove')""",
)
def _(t: Tables):
    return P.drop_removed(t.segments, t.speakers).select("task_id", "idx", "speaker_id")


@query(
    "c04_edits_filter_first",
    """SELECT s.task_id, s.idx, coalesce(p.merged_into, s.speaker_id) AS speaker_id FROM segments s
    LEFT JOIN speakers p ON p.task_id = s.task_id AND p.speaker_id = s.speaker_id
    LEFT JOIN speakers m ON m.task_id = s.task_id AND m.speaker_id = coalesce(p.merged_into, s.speaker_id)
    WHERE coalesce(p.action, '') <> 'remove' AND coalesce(p.include, TRUE) AND coalesce(m.action, '') <> 'remove'""",
)
def _(t: Tables):
    return P.apply_speaker_edits(t.segments, t.speakers, "filter_first").select("task_id", "idx", "speaker_id")


@query(
    "c05_edits_merge_first",
    "SELECT task_id, idx, effective_speaker_id AS speaker_id FROM effective WHERE action <> 'remove'",
    merges=MERGES, effective=EFFECTIVE,
)
def _(t: Tables):
    return P.apply_speaker_edits(t.segments, t.speakers, "merge_first").select("task_id", "idx", "speaker_id")


@query(
    "c05_effective_speakers",
    "SELECT task_id, idx, speaker_id, effective_speaker_id, action FROM effective",
    merges=MERGES, effective=EFFECTIVE,
)
def _(t: Tables):
    return P.effective_speakers(t.segments, t.speakers).select("task_id", "idx", "speaker_id", "effective_speaker_id", "action")


@query("g02_merge_map", "SELECT task_id, speaker_id, master FROM merges", merges=MERGES)
def _(t: Tables):
    return P.merge_map(t.speakers)


@query(
    "c06_voice_sample",
    "SELECT task_id, idx, voice_sample FROM sampled",
    merges=MERGES, effective=EFFECTIVE, sampled=SAMPLED,
)
def _(t: Tables):
    return P.voice_sample(t.segments, t.speakers).select("task_id", "idx", "voice_sample")


NAME = """SELECT s.task_id, s.idx, coalesce({name}, 'Speaker ' || (s.speaker_id + 1)) AS speaker_name FROM segments s
LEFT JOIN speakers p ON p.task_id = s.task_id AND p.speaker_id = s.speaker_id"""


@query("c07_speaker_name", NAME.format(name="p.name"))
def _(t: Tables):
    return P.with_speaker_name(t.segments, t.speakers).select("task_id", "idx", "speaker_name")


@query("c07_speaker_name_blank_is_missing", NAME.format(name="nullif(trim(p.name), '')"))
def _(t: Tables):
    return P.with_speaker_name(t.segments, t.speakers, blank_is_missing=True).select("task_id", "idx", "speaker_name")


def edits(t: Tables):
    return t.spark.sql(EDITS.replace("//", "DIV").replace("FROM segments", "FROM {segments}"), segments=t.segments)


@query(
    "c08_merge_edits",
    """SELECT s.task_id, s.idx, CASE WHEN o.task_id IS NOT NULL THEN o.original_text ELSE s.original_text END AS original_text,
    CASE WHEN r.task_id IS NOT NULL THEN r.translated_text ELSE s.translated_text END AS translated_text FROM segments s
    LEFT JOIN (SELECT * FROM edits WHERE has_original QUALIFY row_number() OVER (PARTITION BY task_id, idx ORDER BY seq DESC) = 1) o
      ON o.task_id = s.task_id AND o.idx = s.idx
    LEFT JOIN (SELECT * FROM edits WHERE has_translated QUALIFY row_number() OVER (PARTITION BY task_id, idx ORDER BY seq DESC) = 1) r
      ON r.task_id = s.task_id AND r.idx = s.idx""",
    edits=EDITS.replace("STRING", "VARCHAR"),
)
def _(t: Tables):
    return S.merge_edits(t.segments, edits(t)).select("task_id", "idx", "original_text", "translated_text")


@query(
    "c09_merge_speaker_config",
    """SELECT n.task_id, n.speaker_key, coalesce(n.name, o.name) AS name, coalesce(n.action, o.action) AS action, o.sample_path
    FROM (SELECT task_id, CASE WHEN speaker_id = 3 THEN '_meta' ELSE CAST(speaker_id + 1 AS VARCHAR) END AS speaker_key,
      CASE WHEN speaker_id = 1 THEN NULL ELSE name END AS name, action FROM speakers) n
    LEFT JOIN speakers o ON o.task_id = n.task_id AND CAST(o.speaker_id AS VARCHAR) = n.speaker_key WHERE NOT starts_with(n.speaker_key, '_')""",
)
def _(t: Tables):
    old = t.speakers.select("task_id", F.col("speaker_id").cast("string").alias("speaker_key"), "name", "action", "sample_path")
    new = t.speakers.select(
        "task_id",
        F.when(F.col("speaker_id") == 3, "_meta").otherwise((F.col("speaker_id") + 1).cast("string")).alias("speaker_key"),
        F.when(F.col("speaker_id") != 1, F.col("name")).alias("name"),
        "action",
    )
    return P.merge_speaker_config(old, new).select("task_id", "speaker_key", "name", "action", "sample_path")


@query(
    "c12_lookup_segment",
    """SELECT k.task_id, k.asked, CASE WHEN a.idx IS NOT NULL THEN 'idx' WHEN b.idx IS NOT NULL THEN 'place' END AS matched_by,
    coalesce(a.idx, b.idx) AS idx, CASE WHEN a.idx IS NOT NULL THEN a.event_id ELSE b.event_id END AS event_id
    FROM (SELECT task_id, idx AS asked FROM segments) k
    LEFT JOIN (SELECT * FROM odd) a ON a.task_id = k.task_id AND a.idx = k.asked
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY idx) - 1 AS place FROM odd) b ON b.task_id = k.task_id AND b.place = k.asked""",
    odd="SELECT * REPLACE (2 * idx + 1 AS idx) FROM segments",
)
def _(t: Tables):
    # Segments are renumbered 1, 3, 5, so that every second number is only a place in the list.
    asked = t.segments.select("task_id", F.col("idx").alias("asked"))
    odd = t.segments.withColumn("idx", F.col("idx") * 2 + 1)
    return S.lookup_segment(odd, asked).select("task_id", "asked", "matched_by", "idx", "event_id")


@query(
    "c15_speakers_from_groups",
    """SELECT t.task_id, t.speaker_id, t.name, CASE WHEN m.master IS NOT NULL THEN 'remove' WHEN t.is_dub THEN 'dub' ELSE 'remove' END AS action,
    m.master AS merged_into, coalesce(g.merged, '') AS merged_speakers
    FROM (SELECT task_id, speaker_id, name, coalesce(action, 'dub') = 'dub' AS is_dub FROM speakers) t
    LEFT JOIN (SELECT task_id, 2 AS speaker_id, 0 AS master FROM speakers WHERE speaker_id = 0 AND task_id % 2 = 0
      UNION ALL SELECT task_id, 3, CAST(CASE WHEN task_id % 2 = 0 THEN 0 ELSE 1 END AS INT) FROM speakers WHERE speaker_id = 0) m
      ON m.task_id = t.task_id AND m.speaker_id = t.speaker_id
    LEFT JOIN (SELECT task_id, CAST(CASE WHEN task_id % 2 = 0 THEN 0 ELSE 1 END AS INT) AS speaker_id, CASE WHEN task_id % 2 = 0 THEN '2,3' ELSE '3' END AS merged
      FROM speakers WHERE speaker_id = 0) g ON g.task_id = t.task_id AND g.speaker_id = t.speaker_id""",
)
def _(t: Tables):
    one = t.speakers.where(F.col("speaker_id") == 0)
    ids = F.when(F.col("task_id") % 2 == 0, F.array(F.lit(0), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(3)))
    groups = one.select("task_id", F.lit(0).alias("group_no"), ids.alias("ids"))
    cards = t.speakers.select("task_id", "speaker_id", "name", (F.coalesce("action", F.lit("dub")) == "dub").alias("is_dub"))
    out = P.speakers_from_groups(groups, cards)
    return out.withColumn("merged_speakers", F.array_join("merged_speakers", ","))


@query(
    "d02_speaker_stats",
    """SELECT task_id, speaker_id, round(sum(end_s - start_s), 2) AS total_duration, count(*) AS intervention_count,
    'Speaker ' || (speaker_id + 1) AS name, 'dub' AS action FROM segments GROUP BY task_id, speaker_id""",
)
def _(t: Tables):
    return P.speaker_stats(t.segments)


@query(
    "d03_phase_counts",
    """SELECT task_id, count(*) FILTER (WHERE length(translated_text) > 0) AS translated, count(*) FILTER (WHERE status = 'completed') AS completed,
    count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'failed') = 0 AND count(*) FILTER (WHERE status = 'completed') > 0 AS success FROM segments GROUP BY task_id""",
)
def _(t: Tables):
    return S.phase_counts(t.segments)


@query(
    "d05_concat_text",
    "SELECT task_id, CAST(0 AS INT) AS part, coalesce(string_agg(original_text, ' ' ORDER BY idx), '') AS text FROM segments GROUP BY task_id",
)
def _(t: Tables):
    return S.concat_text(t.segments)


@query(
    "d05_concat_conversations",
    "SELECT task_id, CAST(0 AS INT) AS part, string_agg(original_text, ' ' ORDER BY idx) AS text FROM transcripts GROUP BY task_id",
)
def _(t: Tables):
    return S.concat_text(t.transcripts)


@query("d06_speaker_count", "SELECT task_id, count(DISTINCT speaker_id) AS num_speakers FROM segments GROUP BY task_id")
def _(t: Tables):
    return P.speaker_count(t.segments)


@query(
    "d07_timeline_length",
    """SELECT task_id, round(max(end_s), 6) AS max_end, greatest(CAST(trunc(max(end_s) * 48000) AS BIGINT),
    max(CAST(trunc(start_s * 48000) AS BIGINT) + event_id)) AS total_samples FROM segments GROUP BY task_id""",
)
def _(t: Tables):
    return S.timeline_length(t.segments.withColumn("samples", F.col("event_id"))).withColumn("max_end", F.round("max_end", 6))


@query(
    "d09_assembly_verdict",
    """SELECT *, CASE WHEN usable = 0 AND failed > 0 THEN 'all_failed' WHEN usable = 0 THEN 'none_created'
    WHEN silent = segments THEN 'all_silent' ELSE 'ok' END AS verdict FROM (
    SELECT task_id, count(*) AS segments, count(*) FILTER (WHERE status = 'completed' AND length(audio_path) > 0) AS usable,
      count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'completed' AND length(error) > 0) AS silent
    FROM segments GROUP BY task_id)""",
)
def _(t: Tables):
    return S.assembly_verdict(t.segments)


@query(
    "d10_all_translated",
    "SELECT task_id, bool_and(length(coalesce(translated_text, '')) > 0) AS all_translated FROM segments GROUP BY task_id",
)
def _(t: Tables):
    return S.all_translated(t.segments)


REFERENCE = """SELECT task_id, speaker_id, idx, rank, round(before, 6) AS used_s, round(before + (rank - 1) * 0.5, 6) AS offset_s FROM (
  SELECT *, coalesce(sum(d) OVER (PARTITION BY task_id, speaker_id ORDER BY d DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CAST(row_number() OVER (PARTITION BY task_id, speaker_id ORDER BY d DESC, idx) AS INT) AS rank
  FROM (SELECT *, end_s - start_s AS d FROM segments)) WHERE before < 60"""


@query("e01_select_reference", REFERENCE)
def _(t: Tables):
    out = P.select_reference(t.segments, budget=60.0)
    used = F.round(F.col("offset_s") - (F.col("rank") - 1) * 0.5, 6).alias("used_s")
    return out.select("task_id", "speaker_id", "idx", "rank", used, six("offset_s"))


@query(
    "e02_speaker_turns",
    "SELECT task_id, turn_no, part, speaker_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, segments, text, speaker_name FROM named_turns",
    **TURN_VIEWS,
)
def _(t: Tables):
    return P.speaker_turns(t.segments, t.speakers).withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query(
    "e07_assign_batches",
    """SELECT task_id, idx, CAST((row_number() OVER w - 1) // 10 + 1 AS INT) AS batch_no,
    CAST(ceil(count(*) OVER (PARTITION BY task_id) / 10.0) AS INT) AS total_batches FROM segments WINDOW w AS (PARTITION BY task_id ORDER BY idx)""",
)
def _(t: Tables):
    return S.assign_batches(t.segments, 10, ["task_id"], ["idx"]).select("task_id", "idx", "batch_no", "total_batches")


@query(
    "e08_log_tail",
    "SELECT task_id, seq, message, style FROM logs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) <= 20",
)
def _(t: Tables):
    return S.log_tail(t.logs, 20)


@query("f04_segments_in_order", "SELECT task_id, idx, round(start_s, 6) AS start_s FROM segments ORDER BY task_id, start_s, idx")
def _(t: Tables):
    return t.segments.orderBy("task_id", "start_s", "idx").select("task_id", "idx", six("start_s"))


@query(
    "f05_longest_first",
    """SELECT task_id, speaker_id, idx, CAST(row_number() OVER (PARTITION BY task_id, speaker_id ORDER BY end_s - start_s DESC, idx) AS BIGINT) AS place FROM segments""",
)
def _(t: Tables):
    from voxlake.plans.ordered import Ordered

    length = F.col("end_s") - F.col("start_s")
    rows = Ordered.of(t.segments, ["task_id", "speaker_id"], [length, "idx"], falling=True).row_number("place").done()
    return rows.select("task_id", "speaker_id", "idx", F.col("place").cast("bigint").alias("place"))


@query(
    "h10_default_labels",
    """SELECT task_id, idx, 'Speaker ' || (speaker_id + 1) AS speaker_name,
    ['alloy', 'echo', 'fable', 'onyx', 'nova', 'shimmer'][(speaker_id + event_id) % 6 + 1] AS voice FROM segments""",
)
def _(t: Tables):
    from voxlake.functions.labels import default_name

    return t.segments.select(
        "task_id", "idx", default_name(F.col("speaker_id")).alias("speaker_name"),
        default_voice(F.col("speaker_id") + F.col("event_id")).alias("voice"),
    )


@query(
    "h20_derived_paths",
    """SELECT s.task_id, s.idx, printf('segment_%04d.wav', s.idx) AS segment_file,
    '/temp_chunks/' || s.task_id || '/' || printf('segment_%04d.wav', s.idx) AS segment_url,
    '/temp_chunks/' || s.task_id || '/speaker_samples/speaker_' || s.speaker_id || '_sample.wav' AS sample_url,
    'outputs/' || s.task_id AS output_dir,
    'dubbed_' || regexp_replace(coalesce(filename, original_filename, 'video.mp4'), '\\.[^.]+$', '') || '.mp4' AS download_name
    FROM segments s JOIN tasks t ON t.task_id = s.task_id""",
)
def _(t: Tables):
    out = S.derived_paths(t.segments.select("task_id", "idx", "speaker_id"), t.tasks)
    return out.select("task_id", "idx", "segment_file", "segment_url", "sample_url", "output_dir", "download_name")


@query(
    "h21_preview_bounds",
    """SELECT s.task_id, s.idx, coalesce(s.audio_path, t.file_path) AS preview_source, round(start_s, 3) AS preview_start,
    round(greatest(0.1, end_s - start_s), 3) AS preview_duration FROM segments s LEFT JOIN tasks t ON t.task_id = s.task_id""",
)
def _(t: Tables):
    out = S.preview_bounds(t.segments, t.tasks)
    return out.select("task_id", "idx", "preview_source", "preview_start", "preview_duration")


@query(
    "i11_save_review",
    """SELECT task_id, idx, original_text FROM segments WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE status = 'awaiting_validation')
    UNION ALL SELECT task_id, idx + 1, concat('edited ', CAST(event_id AS VARCHAR)) FROM segments
    WHERE task_id IN (SELECT task_id FROM tasks WHERE status = 'awaiting_validation') AND speaker_id <> 3""",
)
def _(t: Tables):
    edited = t.segments.where(F.col("speaker_id") != 3).withColumns({
        "idx": F.col("idx") + 1, "original_text": F.concat(F.lit("edited "), F.col("event_id").cast("string")),
    })
    reviewed = t.tasks.where(F.col("status") == "awaiting_validation")
    return L.save_review(t.segments, edited, reviewed).select("task_id", "idx", "original_text")


@query(
    "i11_review_commands",
    """SELECT task_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'confirm_speakers' WHEN 'view' THEN 'confirm_audio' ELSE 'confirm_translation' END AS command
    FROM (SELECT user_id AS task_id, * FROM events) WHERE event_type IN ('click', 'view', 'error') AND event_id % 3 <> 0""",
)
def _(t: Tables):
    review = F.when(F.col("event_type") == "click", "speakers").when(F.col("event_type") == "view", "audio").when(F.col("event_type") == "error", "translation")
    reviews = t.raw("events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), review.alias("review"), (F.col("event_id") % 3 == 0).alias("save_only")
    )
    return L.review_commands(reviews).select("task_id", "seq", "command")


@query(
    "j07_finalize_status",
    """SELECT task_id, idx, CASE WHEN critical IS NOT NULL THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN critical IS NOT NULL THEN 'Critical failure: ' || left(critical, 200)
      WHEN engine IS NOT NULL THEN 'TTS failed, using silence: ' || left(engine, 100)
      WHEN length(error) > 0 THEN error WHEN reason <> 'speak' THEN 'Silent segment (speaker removed or TTS unavailable)' END AS error
    FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN repeat('disk full ', 30) END AS critical,
      CASE WHEN event_id % 6 = 0 THEN repeat('no model ', 30) END AS engine FROM planned)""",
    merges=MERGES, effective=EFFECTIVE, sampled=SAMPLED, planned=PLAN,
)
def _(t: Tables):
    planned = S.synthesis_plan(t.segments, t.speakers).withColumns({
        "critical_error": F.when(F.col("event_id") % 13 == 0, F.lit("disk full " * 30)),
        "engine_error": F.when(F.col("event_id") % 6 == 0, F.lit("no model " * 30)),
    })
    return S.finalize_status(planned).select("task_id", "idx", "status", "error")
