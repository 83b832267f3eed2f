"""Queries about embeddings and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.catalog.bindings import Tables
from voxlake.catalog.registry import query
from voxlake.functions.vectors import l2_normalize
from voxlake.operators import scoring as C
from voxlake.operators import vectors as V

UNIT = """SELECT task_id, idx, label, list_transform(embedding, lambda v: v / sqrt(list_dot_product(embedding, embedding))) AS u FROM vectors"""


@query(
    "h14_l2_normalize",
    "SELECT task_id, idx, CAST(i AS INT) AS place, round(u[i + 1], 6) AS value FROM (SELECT *, unnest(range(64)) AS i FROM scaled)",
    scaled="SELECT task_id, idx, list_transform(embedding, lambda v: 3 * v / sqrt(list_dot_product(list_transform(embedding, lambda w: 3 * w), list_transform(embedding, lambda w: 3 * w)))) AS u FROM vectors",
)
def _(t: Tables):
    scaled = F.transform("embedding", lambda v: v.cast("double") * 3)
    out = t.embeddings.select("task_id", "idx", F.posexplode(l2_normalize(scaled)).alias("place", "value"))
    return out.withColumn("value", F.round("value", 6))


@query(
    "c11_pair_distances",
    """SELECT a.task_id, a.idx AS left_idx, b.idx AS right_idx, round(1 - list_dot_product(a.u, b.u), 6) AS distance
    FROM unit a JOIN unit b ON b.task_id = a.task_id AND b.idx = a.idx + 1""",
    unit=UNIT,
)
def _(t: Tables):
    # The neighbours in each recording; a list of all pairs of a group is never made.
    pairs = t.embeddings.select("task_id", F.col("idx").alias("left_idx"), (F.col("idx") + 1).alias("right_idx"))
    return V.pair_distances(t.embeddings, pairs).withColumn("distance", F.round("distance", 6))


@query(
    "c11_mean_distances",
    """SELECT a.task_id, a.idx, b.label AS group_label, count(*) FILTER (WHERE a.idx <> b.idx) AS others,
    CASE WHEN count(*) FILTER (WHERE a.idx <> b.idx) > 0 THEN round(sum(1 - list_dot_product(a.u, b.u)) / count(*) FILTER (WHERE a.idx <> b.idx), 6) END AS mean_distance
    FROM unit a JOIN unit b ON b.task_id = a.task_id GROUP BY a.task_id, a.idx, a.label, b.label""",
    unit=UNIT,
)
def _(t: Tables):
    return V.mean_distances(t.embeddings).withColumn("mean_distance", F.round("mean_distance", 6))


@query(
    "d08_silhouette",
    """SELECT task_id, round(avg(CASE WHEN n_own <= 1 THEN 0 ELSE coalesce((b - a) / greatest(a, b), 0) END), 6) AS silhouette FROM (
      SELECT task_id, idx, max(n) FILTER (WHERE own) AS n_own, max(d) FILTER (WHERE own) AS a, min(d) FILTER (WHERE NOT own) AS b FROM (
        SELECT a.task_id, a.idx, a.label = b.label AS own, count(*) AS n,
          sum(CASE WHEN a.idx <> b.idx THEN 1 - list_dot_product(a.u, b.u) ELSE 0 END) / nullif(count(*) FILTER (WHERE a.idx <> b.idx), 0) AS d
        FROM unit a JOIN unit b ON b.task_id = a.task_id GROUP BY a.task_id, a.idx, a.label, b.label)
      GROUP BY task_id, idx) GROUP BY task_id""",
    unit=UNIT,
)
def _(t: Tables):
    return V.silhouette(t.embeddings).withColumn("silhouette", F.round("silhouette", 6))


def speaker_views(vectors: str) -> dict[str, str]:
    """SQL views that end in ``speakers_found`` (task_id, idx, speaker_id): the closest two clusters are joined, again and
    again, and of all numbers of speakers the silhouette decides."""
    return {
        "usable": vectors,
        "numbered": "SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY idx) AS INT) AS p, count(*) OVER (PARTITION BY task_id) AS n FROM usable",
        "apart": "SELECT a.task_id, a.p AS i, b.p AS j, 1 - list_dot_product(a.u, b.u) AS d FROM numbered a JOIN numbered b ON b.task_id = a.task_id AND a.p <> b.p",
        "tree": """SELECT task_id, count(*) AS n, 0 AS step, list(p ORDER BY p) AS own FROM numbered GROUP BY task_id
          UNION ALL
          SELECT task_id, n, step + 1, list_transform(own, lambda x: CASE WHEN x = m.b THEN m.a ELSE x END) FROM (
            SELECT task_id, n, step, own, min({'d': d, 'a': a, 'b': b}) AS m FROM (
              SELECT t.task_id, n, step, own, own[i] AS a, own[j] AS b, round(avg(d), 12) AS d FROM tree t JOIN apart x ON x.task_id = t.task_id AND own[i] < own[j]
              GROUP BY t.task_id, n, step, own, own[i], own[j]) GROUP BY task_id, n, step, own)""",
        "tried": "SELECT task_id, n - step AS k, own FROM tree WHERE n >= 3 AND n - step BETWEEN 2 AND least(n - 1, 10)",
        "spread": """SELECT t.task_id, k, i, own[i] AS mine, own[j] AS theirs, avg(d) AS d FROM tried t JOIN apart x ON x.task_id = t.task_id
          GROUP BY t.task_id, k, i, own[i], own[j]""",
        "points": """SELECT task_id, k, i, max(d) FILTER (WHERE mine = theirs) AS a, min(d) FILTER (WHERE mine <> theirs) AS b FROM spread GROUP BY task_id, k, i""",
        "scored": "SELECT task_id, k, round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / greatest(a, b), 0) END), 12) AS s FROM points GROUP BY task_id, k",
        "chosen": """SELECT task_id, list_reduce(list_prepend({'k': 1, 's': CAST(-1 AS DOUBLE)}, list({'k': k, 's': s} ORDER BY k)),
          lambda best, x: CASE WHEN x.s > best.s + 0.15 THEN x ELSE best END) AS c FROM scored GROUP BY task_id""",
        "speakers_found": """SELECT m.task_id, m.idx, CAST(CASE WHEN own IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY m.task_id ORDER BY own[p]) - 1 END AS INT) AS speaker_id
          FROM numbered m LEFT JOIN (SELECT t.task_id, own FROM tried t JOIN chosen c ON c.task_id = t.task_id AND c.c.k = t.k AND c.c.s >= 0.4) w ON w.task_id = m.task_id""",
    }


USABLE = "SELECT task_id, idx, list_transform(embedding, lambda v: v / sqrt(list_dot_product(embedding, embedding))) AS u FROM vectors"


@query("j04_cluster_speakers", "SELECT task_id, idx, speaker_id FROM speakers_found", **speaker_views(USABLE))
def _(t: Tables):
    return V.cluster_speakers(t.embeddings)


# One vector in nine is missing, and in every fifth recording all but the first.
HELD = "task_id % 5 <> 3 AND (task_id * 20 + idx) % 9 <> 4 OR task_id % 5 = 3 AND idx = 0"


@query(
    "j05_assign_speakers",
    "SELECT s.task_id, s.idx, coalesce(f.speaker_id, 0) AS speaker_id FROM segments s LEFT JOIN speakers_found f ON f.task_id = s.task_id AND f.idx = s.idx",
    **speaker_views(f"{USABLE} WHERE {HELD}"),
)
def _(t: Tables):
    embeddings = t.embeddings.withColumn("embedding", F.when(F.expr(HELD), F.col("embedding")))
    return V.assign_speakers(t.segments, embeddings).select("task_id", "idx", "speaker_id")


def upper_provider():
    """A stand-in for a model: upper case, and no answer for texts that hold a 7."""

    def call(text: str) -> str:
        if "7" in text:
            raise RuntimeError("no answer")
        return text.upper()

    return call


@query(
    "j01_score_keep_input",
    """SELECT task_id, idx, CASE WHEN used THEN CASE WHEN contains(original_text, '7') THEN original_text ELSE upper(trim(original_text)) END ELSE translated_text END AS translated_text,
    CASE WHEN used THEN 'translated' ELSE status END AS status, CAST(CASE WHEN NOT used THEN 0 WHEN contains(original_text, '7') THEN 3 ELSE 1 END AS INT) AS attempts
    FROM (SELECT *, coalesce(length(original_text) > 0, FALSE) AND status <> 'failed' AS used FROM segments)""",
)
def _(t: Tables):
    out = C.score(t.segments.drop("ts"), upper_provider, pause=None)
    return out.select("task_id", "idx", "translated_text", "status", "attempts")


def upper_lists():
    """``upper_provider`` for lists of texts."""
    one = upper_provider()

    def call(text: str) -> object:
        try:
            return one(text)
        except RuntimeError as problem:
            return problem

    return C.lists(lambda texts: [call(t) for t in texts])


@query(
    "j01_score_in_lists",
    """SELECT task_id, idx, CASE WHEN used THEN CASE WHEN contains(original_text, '7') THEN original_text ELSE upper(trim(original_text)) END ELSE translated_text END AS translated_text,
    CAST(CASE WHEN NOT used THEN 0 WHEN contains(original_text, '7') THEN 3 ELSE 1 END AS INT) AS attempts
    FROM (SELECT *, coalesce(length(original_text) > 0, FALSE) AND status <> 'failed' AS used FROM segments)""",
)
def _(t: Tables):
    return C.score(t.segments.drop("ts"), upper_lists, pause=None, list_size=5).select("task_id", "idx", "translated_text", "attempts")


@query(
    "j01_score_mark_failed",
    """SELECT task_id, idx, CASE WHEN NOT used THEN translated_text WHEN NOT contains(original_text, '7') THEN upper(trim(original_text)) END AS translated_text,
    CASE WHEN used THEN CASE WHEN contains(original_text, '7') THEN 'failed' ELSE 'translated' END ELSE status END AS status,
    CASE WHEN used AND contains(original_text, '7') THEN 'no answer' ELSE error END AS error
    FROM (SELECT *, coalesce(length(original_text) > 0, FALSE) AND status <> 'failed' AS used FROM segments)""",
)
def _(t: Tables):
    out = C.score(t.segments.drop("ts"), upper_provider, pause=None, on_fail="error")
    return out.select("task_id", "idx", "translated_text", "status", "error")


@query(
    "j01_score_identity",
    """SELECT task_id, idx, CASE WHEN coalesce(length(original_text) > 0, FALSE) AND status <> 'failed' THEN original_text ELSE translated_text END AS translated_text FROM segments""",
)
def _(t: Tables):
    return C.score(t.segments, None).select("task_id", "idx", "translated_text")


def reversed_provider():
    def call(text: str) -> str:
        if "!" in text:
            raise RuntimeError("AVX not available")
        return text[::-1]

    return call


@query(
    "j02_route_engines",
    """SELECT task_id, idx, used AS engine_used, CASE WHEN used IS NULL THEN NULL WHEN used = 'fishspeech' THEN upper(txt) ELSE reverse(txt) END AS result, state AS status FROM (
      SELECT *, CASE WHEN engine = 'f5' AND sample IS NOT NULL AND contains(txt, '!') THEN 'fishspeech'
          WHEN engine IN ('f5', 'fishspeech') AND sample IS NOT NULL THEN engine WHEN engine = 'bark' THEN engine END AS used,
        CASE WHEN engine = 'other' OR (engine IN ('f5', 'fishspeech') AND sample IS NULL) THEN 'error' ELSE 'ok' END AS state
      FROM (SELECT *, 'say ' || event_id || CASE WHEN event_id % 10 = 3 THEN '!' ELSE '' END AS txt, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x.wav' END AS sample,
        CASE WHEN event_id % 10 = 3 THEN 'f5' ELSE ['f5', 'bark', 'fishspeech', 'other'][event_id % 4 + 1] END AS engine FROM segments))""",
)
def _(t: Tables):
    event = F.col("event_id")
    engine = F.element_at(F.array(*[F.lit(e) for e in ("F5", "bark", "fishspeech", "other")]), (event % 4 + 1).cast("int"))
    rows = t.segments.select(
        "task_id", "idx",
        F.concat(F.lit("say "), event.cast("string"), F.when(event % 10 == 3, "!").otherwise("")).alias("translated_text"),
        F.when(event % 10 == 3, "f5").otherwise(engine).alias("engine"),
        F.when(event % 3 != 0, "x.wav").alias("voice_sample"),
    )
    registry = {"f5": reversed_provider, "bark": reversed_provider, "fishspeech": upper_provider_plain}
    out = C.route_scores(rows, registry, fallback={"f5": "fishspeech"})
    used = F.when(F.col("status") == "ok", F.col("engine_used"))
    return out.select("task_id", "idx", used.alias("engine_used"), "result", "status")


def upper_provider_plain():
    return lambda text: text.upper()


def tone_provider():
    """A signal from a text: silent for texts that hold a 9, else a tone as loud as the text is long."""

    def call(text: str) -> list[float]:
        level = 0.0 if "9" in text else 1.0
        return [level * (1.0 if i % 2 else -1.0) for i in range(len(text))]

    return call


@query(
    "j03_quality_gate",
    """SELECT task_id, idx, CASE WHEN NOT contains(original_text, '9') THEN CAST(length(original_text) AS INT) END AS samples,
    CASE WHEN contains(original_text, '9') THEN 'failed' ELSE 'translated' END AS status,
    CASE WHEN contains(original_text, '9') THEN 'near-silent output' END AS error FROM segments WHERE length(original_text) > 0""",
)
def _(t: Tables):
    rows = t.segments.where(F.length("original_text") > 0).select("task_id", "idx", "original_text")
    out = C.score(rows, tone_provider, out_col="signal", pause=None, on_fail="error", gate=C.quality_gate, out_type="array<double>")
    return out.select("task_id", "idx", F.when(F.col("signal").isNotNull(), F.size("signal")).alias("samples"), "status", "error")


@query(
    "j08_analyze",
    """SELECT task_id, CAST(length(prompt) AS VARCHAR) || ':' || md5(prompt) AS analysis FROM (
      SELECT task_id, 'You are an expert summarizer. Summarize the following text concisely.' || E'\\n\\nTEXT:\\n' || string_agg(original_text, ' ' ORDER BY idx) AS prompt
      FROM transcripts GROUP BY task_id)""",
)
def _(t: Tables):
    return C.analyze(t.transcripts, "summary", digest_provider).select("task_id", "analysis")


def digest_provider():
    """Stands for a model: an answer that depends on every character of the prompt."""
    from hashlib import md5

    return lambda prompt: f"{len(prompt)}:{md5(prompt.encode()).hexdigest()}"


@query("j01_copy_same_language", "SELECT task_id, idx, original_text AS translated_text, 'translated' AS status FROM segments")
def _(t: Tables):
    return C.copy_texts(t.segments).select("task_id", "idx", "translated_text", "status")


@query("j08_unknown_mode", "SELECT DISTINCT task_id, 'Unknown mode' AS error FROM transcripts")
def _(t: Tables):
    return C.analyze(t.transcripts, "poem", upper_provider_plain).select("task_id", "error")
