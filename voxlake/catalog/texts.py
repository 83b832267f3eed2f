"""Queries about text, conversions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.catalog.bindings import Tables
from voxlake.catalog.registry import query
from voxlake.functions import convert as C
from voxlake.functions import labels as LB
from voxlake.functions import text as X
from voxlake.sources.media import media_columns

STRIP = r"E' \n\t\r'"
WS = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
CLEANED = rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\.{{2,}}', ',', 'g'), '-{{2,}}', ',', 'g'),
  '[{WS}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_{WS},.?!'']', '', 'g')) AS c FROM dirty"""
# Half of the texts get dots, dashes and no closing mark.
DIRTY = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN text ELSE concat(text, ' wait... no--yes #', doc_id, ' ') END AS raw FROM documents"


def dirty(t: Tables):
    return t.spark.sql(DIRTY.replace("FROM documents", "FROM {documents}"), documents=t.raw("documents"))


@query("h01_clean_text", "SELECT doc_id, CASE WHEN c IS NULL THEN '' WHEN c = '' OR right(c, 1) IN ('.', '!', '?', ',') THEN c ELSE c || '.' END AS cleaned FROM cleaned",
       dirty=DIRTY, cleaned=CLEANED)
def _(t: Tables):
    return dirty(t).select("doc_id", X.clean_text(F.col("raw")).alias("cleaned"))


PACK = rf"""SELECT doc_id, CAST(n - 1 AS INT) AS chunk_no, chunk FROM (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS n FROM (
  SELECT doc_id, CASE WHEN w = '' THEN CAST([] AS VARCHAR[]) WHEN length(w) <= {{limit}} THEN [w]
    WHEN f.opened = '' THEN f.chunks ELSE list_append(f.chunks, rtrim(f.opened)) END AS chunks FROM (
  SELECT doc_id, w, list_reduce(list_filter(list_transform(string_split(translate(w, '!?', '..'), '.'), lambda s: trim(s, {STRIP})), lambda s: length(s) > 0),
    lambda a, s: {{{{'chunks': CASE WHEN length(a.opened) + length(s) + 1 <= {{limit}} OR a.opened = '' THEN a.chunks ELSE list_append(a.chunks, rtrim(a.opened)) END,
      'opened': CASE WHEN length(a.opened) + length(s) + 1 <= {{limit}} THEN a.opened || s || '. ' ELSE s || '. ' END}}}},
    {{{{'chunks': CAST([] AS VARCHAR[]), 'opened': ''}}}}) AS f FROM (SELECT doc_id, trim(text, {STRIP}) AS w FROM documents))))"""


@query("h02_pack_sentences", PACK.format(limit=250))
def _(t: Tables):
    return t.raw("documents").select("doc_id", F.posexplode(X.pack_sentences(F.col("text"), 250)).alias("chunk_no", "chunk"))


@query("h02_pack_sentences_200", PACK.format(limit=200))
def _(t: Tables):
    return t.raw("documents").select("doc_id", F.posexplode(X.pack_sentences(F.col("text"), 200)).alias("chunk_no", "chunk"))


NAMES = "CASE {c} " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n, _ in K.LANGUAGES) + " ELSE {c} END"
SHORT = "CASE {c} " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n, _ in K.LANGUAGES[: K.SHORT_LANGUAGE_LIST]) + " ELSE {c} END"
# Targets in turn: known codes, a code only the long list has, an unknown one.
TARGETS = "SELECT *, CASE doc_id % 6 WHEN 0 THEN 'de' WHEN 1 THEN 'english' WHEN 2 THEN 'nl' WHEN 3 THEN 'tlh' WHEN 4 THEN 'FRA' ELSE lang END AS target FROM documents"


def targets(t: Tables):
    return t.spark.sql(TARGETS.replace("FROM documents", "FROM {documents}"), documents=t.raw("documents"))


@query("h03_translation_prompt",
       f"""SELECT doc_id, E'Translate the following text to ' || n || E'. \\nPreserve the meaning, tone, and style. Only output the translation, no explanations.\\n\\nText: '
       || text || E'\\n\\nTranslation to ' || n || ':' AS prompt FROM (SELECT *, {NAMES.format(c='target')} AS n FROM targets)""", targets=TARGETS)
def _(t: Tables):
    return targets(t).select("doc_id", X.translation_prompt(F.col("text"), LB.language_name(F.col("target"))).alias("prompt"))


@query("h03_short_prompt", "SELECT doc_id, 'Translate to ' || target || ': ' || text AS prompt FROM targets", targets=TARGETS)
def _(t: Tables):
    return targets(t).select("doc_id", X.translation_prompt(F.col("text"), F.col("target"), short=True).alias("prompt"))


@query("h04_analysis_prompt",
       """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'You are an expert summarizer. Summarize the following text concisely.' || E'\\n\\nTEXT:\\n' || text
       WHEN 1 THEN 'You are a secretary. Create a structured meeting report with Agenda, Key Points, and Action Items.' || E'\\n\\nTEXT:\\n' || text END AS prompt,
       CASE WHEN doc_id % 3 = 2 THEN 'Unknown mode' END AS error FROM documents""")
def _(t: Tables):
    mode = F.when(F.col("doc_id") % 3 == 0, "summary").when(F.col("doc_id") % 3 == 1, "meeting_report").otherwise("poem")
    return t.raw("documents").select("doc_id", X.analysis_prompt(F.col("text"), mode).alias("prompt"), X.analysis_error(mode).alias("error"))


@query("h05_format_time",
       """SELECT event_id, CASE WHEN v IS NULL OR v = 0 THEN '00:00' ELSE CASE WHEN floor(v / 60) < 10 THEN '0' ELSE '' END || CAST(CAST(floor(v / 60) AS BIGINT) AS VARCHAR) || ':'
       || lpad(CAST(CAST(floor(v) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS shown
       FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value * 30 END AS v FROM events)""")
def _(t: Tables):
    seconds = F.when(F.col("event_id") % 10 != 0, F.col("value") * 30)
    return t.raw("events").select("event_id", C.format_time(seconds).alias("shown"))


@query("h06_format_size",
       """SELECT o_orderkey, CASE WHEN b = 0 THEN '0 B' ELSE regexp_replace(format('{:.1f}', round(b / pow(1024, p), 1)), '\\.0$', '') || [' B', ' KB', ' MB', ' GB'][p + 1] END AS shown
       FROM (SELECT o_orderkey, b, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 ELSE 3 END AS p FROM (
         SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5003 ELSE 7000003 END AS b FROM orders))""")
def _(t: Tables):
    factor = F.element_at(F.array(*[F.lit(v) for v in (0, 1, 5003, 7000003)]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    size = F.floor("o_totalprice") * factor
    return t.raw("orders").select("o_orderkey", C.format_size(size).alias("shown"))


@query("h07_truncate", "SELECT doc_id, CASE WHEN length(text) > 35 THEN left(text, 32) || '...' ELSE text END AS title FROM documents")
def _(t: Tables):
    return t.raw("documents").select("doc_id", X.truncate(F.col("text"), 35).alias("title"))


@query("h08_status_label", "SELECT o_orderkey, o_orderpriority AS label FROM orders")
def _(t: Tables):
    return t.raw("orders").select("o_orderkey", LB.status_label(F.translate("o_orderpriority", " ", "_")).alias("label"))


@query("h09_web_path",
       """SELECT task_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS web_path FROM (
       SELECT task_id, CASE WHEN task_id % 2 = 0 THEN output_path ELSE file_path END AS p FROM tasks)""")
def _(t: Tables):
    path = F.when(F.col("task_id") % 2 == 0, F.translate("output_path", "/", "\\")).otherwise(F.col("file_path"))
    return t.tasks.select("task_id", C.web_path(path).alias("web_path"))


MESSAGES = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(text, ' Illegal Instruction') WHEN 1 THEN concat('AVX: ', text) WHEN 2 THEN concat('__SVML ', text)
  ELSE text END AS message FROM documents"""


def messages(t: Tables):
    return t.spark.sql(MESSAGES.replace("FROM documents", "FROM {documents}"), documents=t.raw("documents"))


@query("h12_cpu_error",
       "SELECT doc_id, regexp_matches(lower(message), '" + "|".join(K.CPU_ERROR_WORDS) + "') AS short_list, regexp_matches(lower(message), '"
       + "|".join(K.CPU_ERROR_WORDS_LONG) + "') AS long_list FROM messages", messages=MESSAGES)
def _(t: Tables):
    message = F.col("message")
    return messages(t).select("doc_id", X.is_cpu_error(message).alias("short_list"), X.is_cpu_error(message, True).alias("long_list"))


@query("h13_error_text",
       """SELECT doc_id, '[Transcription error: ' || left(text, 50) || ']' AS transcription, 'TTS failed, using silence: ' || left(text, 100) AS synthesis,
       'Critical failure: ' || left(text, 200) AS critical FROM documents""")
def _(t: Tables):
    kinds = ("transcription", "synthesis", "critical")
    return t.raw("documents").select("doc_id", *[X.error_text(F.col("text"), kind).alias(kind) for kind in kinds])


@query("h15_iso_times",
       """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS seconds,
       event_id % 4 <> 0 AS is_time FROM events""")
def _(t: Tables):
    iso = C.iso_text(F.col("ts"))
    back = C.iso_time(F.when(F.col("event_id") % 4 == 0, F.lit("soon")).otherwise(iso))
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return t.raw("events").select("event_id", iso.alias("iso"), seconds.alias("seconds"), back.isNotNull().alias("is_time"))


@query("b01_parse_json",
       """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INT) END AS k FROM events""")
def _(t: Tables):
    broken = t.raw("events").withColumn("props", F.when(F.col("event_id") % 10 == 0, "{not json").when(F.col("event_id") % 5 != 0, F.col("props")))
    return C.parse_json_columns(broken, {"props": "k int"}).select("event_id", F.col("props.k").alias("k"))


@query("h16_json_round_trip", "SELECT event_id, props = concat('{\"k\": ', json_extract_string(props, '$.k'), '}') AS same, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    parsed = F.from_json("props", "k bigint")
    spaced = F.replace(F.to_json(parsed), F.lit(":"), F.lit(": "))
    return t.raw("events").select("event_id", (spaced == F.col("props")).alias("same"), parsed["k"].alias("k"))


@query("h17_collections",
       """SELECT doc_id, array_to_string(w[greatest(len(w) - 2, 1):], ' ') AS tail, CASE lang WHEN 'en' THEN 'dub' WHEN 'fr' THEN 'remove' ELSE 'none' END AS looked_up,
       CASE WHEN lang = 'en' THEN 'new' ELSE 'dub' END AS updated FROM (SELECT *, string_split(text, ' ') AS w FROM documents)""")
def _(t: Tables):
    words = F.split("text", " ")
    config = F.create_map(F.lit("en"), F.lit("dub"), F.lit("fr"), F.lit("remove"))
    from voxlake.operators.lifecycle import merge_maps

    updated = merge_maps(config, F.create_map(F.col("lang"), F.lit("new")))
    return t.raw("documents").select(
        "doc_id", F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3), " ").alias("tail"),
        F.coalesce(F.try_element_at(config, F.col("lang")), F.lit("none")).alias("looked_up"),
        updated["en"].alias("updated"),
    )


WORDS = """SELECT event_id, CASE event_id % 15 WHEN 0 THEN 'true' WHEN 1 THEN ' Yes ' WHEN 2 THEN '1' WHEN 3 THEN 'on' WHEN 4 THEN 'no' WHEN 5 THEN '0'
  WHEN 6 THEN '2' WHEN 7 THEN '-3' WHEN 8 THEN 'maybe' WHEN 9 THEN NULL WHEN 10 THEN 'Y' WHEN 11 THEN 'n' WHEN 12 THEN 'OFF' WHEN 13 THEN '' ELSE 'False' END AS word FROM events"""


@query("b02_loose_booleans",
       """SELECT event_id, CASE WHEN w IN ('true', 'yes', '1', 'on') THEN TRUE WHEN w IN ('false', 'no', '0', 'off') THEN FALSE ELSE coalesce(TRY_CAST(w AS BIGINT) <> 0, FALSE) END AS read,
       coalesce(lower(word) IN ('true', 'yes', '1', 'on'), FALSE) AS written,
       CASE WHEN w IN ('true', '1', 'yes', 'y', 'on') THEN TRUE WHEN w IN ('false', '0', 'no', 'n', 'off') THEN FALSE ELSE TRUE END AS config
       FROM (SELECT *, lower(trim(word)) AS w FROM words)""", words=WORDS)
def _(t: Tables):
    words = t.spark.sql(WORDS.replace("FROM events", "FROM {events}"), events=t.raw("events"))
    word = F.col("word")
    return words.select(
        "event_id", C.to_bool(word, "read").alias("read"), C.to_bool(word, "write").alias("written"), C.to_bool(word, "config", True).alias("config")
    )


CODES = "CASE lower({c}) " + " ".join(f"WHEN '{a}' THEN '{c}'" for c, _, al in K.LANGUAGES for a in al) + " ELSE lower({c}) END"


@query("b12_needs_translation", f"SELECT doc_id, {CODES.format(c='lang')} <> {CODES.format(c='target')} AS needed FROM targets", targets=TARGETS)
def _(t: Tables):
    return targets(t).select("doc_id", LB.needs_translation(F.col("lang"), F.col("target")).alias("needed"))


CLASSED = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '?! ...' WHEN 2 THEN 'Привет' WHEN 3 THEN NULL ELSE text END AS text FROM documents"""


@query("b13_text_class",
       rf"""SELECT doc_id, CASE WHEN coalesce(trim(text, {STRIP}), '') = '' THEN 'empty' WHEN trim(regexp_replace(text, '[^\p{{L}}\p{{N}}_{WS}]', '', 'g'), {STRIP}) = '' THEN 'symbols'
       WHEN NOT regexp_matches(text, '[a-zA-Z0-9]') THEN 'non_ascii' ELSE 'words' END AS kind FROM classed""", classed=CLASSED)
def _(t: Tables):
    classed = t.spark.sql(CLASSED.replace("FROM documents", "FROM {documents}"), documents=t.raw("documents"))
    return classed.select("doc_id", X.text_class(F.col("text")).alias("kind"))


@query("c14_language_name", f"SELECT doc_id, {NAMES.format(c='target')} AS long_name, {SHORT.format(c='target')} AS short_name FROM targets", targets=TARGETS)
def _(t: Tables):
    target = F.col("target")
    return targets(t).select("doc_id", LB.language_name(target).alias("long_name"), LB.language_name(target, short=True).alias("short_name"))


PATHS = """SELECT task_id, CASE task_id % 6 WHEN 0 THEN concat('/up/', md5(CAST(task_id AS STRING)), '_talk ', CAST(task_id AS STRING), '.MP4') WHEN 1 THEN concat('/up/short_', CAST(task_id AS STRING), '.webm')
  WHEN 2 THEN '/up/noext' WHEN 3 THEN '/up/.hidden' WHEN 4 THEN concat('/up/a.b/c.', CAST(task_id AS STRING), '.mov') ELSE concat('/up/', CAST(task_id AS STRING), '.avi') END AS path FROM tasks"""


@query("a03_media_columns",
       r"""SELECT task_id, name, regexp_replace(name, '(.)\.[^.]+$', '\1') AS stem, ext AS extension, CASE ext WHEN '.mp4' THEN 'video/mp4' WHEN '.webm' THEN 'video/webm'
       WHEN '.mkv' THEN 'video/x-matroska' WHEN '.mov' THEN 'video/quicktime' ELSE 'application/octet-stream' END AS media_type,
       ext IN ('.mp4', '.mkv', '.mov', '.avi', '.webm') AS is_video,
       CASE WHEN contains(name, '_') AND length(split_part(name, '_', 1)) > 30 THEN substr(name, length(split_part(name, '_', 1)) + 2) ELSE name END AS display_name
       FROM (SELECT task_id, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\.[^.]+)$', 1)) AS ext FROM paths)""",
       paths=PATHS)
def _(t: Tables):
    paths = t.spark.sql(PATHS.replace("FROM tasks", "FROM {tasks}"), tasks=t.tasks)
    return paths.withColumns(media_columns(F.col("path"))).drop("path")


@query("h18_backoff",
       """SELECT task_id, task_name, array_to_string(list_transform(range(a - 1), lambda n: CAST((n + 1) * 2 AS INT)), ',') AS linear,
       array_to_string(list_transform(range(a - 1), lambda n: CAST(pow(2, n) AS INT)), ',') AS exponential,
       array_to_string(list_transform(range(a - 1), lambda n: CAST((n + 1) * 5 AS INT)), ',') AS half_tenths
       FROM (SELECT task_id, task_name, attempt_count AS a FROM steps)""")
def _(t: Tables):
    def shown(kind: str, scale: int = 1):
        return F.array_join(F.transform(C.backoff_column(kind, F.col("attempt_count")), lambda w: (w * scale).cast("int").cast("string")), ",")

    return t.steps.select(
        "task_id", "task_name", shown("linear").alias("linear"), shown("exponential").alias("exponential"), shown("half", 10).alias("half_tenths")
    )
