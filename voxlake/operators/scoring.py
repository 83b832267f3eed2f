"""Batch scoring of rows by a pluggable provider: retries, fallback, routing, gates, resuming.

A provider is a factory: it is called once per task and returns a function.  One marked with ``lists`` takes a list
of texts and gives a list of results in their order, where an exception fails its row; any other takes one text.
Rows stay in Arrow batches: all texts of a batch that are still to do are asked together, and those that failed are
asked again together after one pause.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake import constants as K
from voxlake.functions import text as X
from voxlake.functions.convert import backoff
from voxlake.operators.segments import concat_text
from voxlake.plans.spread import spread
from voxlake.session import checkpoint_dir

Provider = Callable[[], Callable[[str], object] | Callable[[list[str]], list[object]]]


def quality_gate(values: object, max_peak: float = 10.0) -> str | None:
    """Why a generated signal is rejected, or None."""
    signal = np.asarray(values, dtype=float)
    if signal.size == 0:
        return "empty output"
    if np.std(signal) < 0.001:
        return "near-silent output"
    if np.max(np.abs(signal)) > max_peak:
        return "clipped output"
    if not np.isfinite(signal).all():
        return "non-finite output"
    return None


LIST_SIZE = 64  # texts of one call
TASK_CHARS = 1 << 22  # characters of transcripts that go to one task


def lists(call: Callable[[list[str]], list[object]]) -> Callable[[list[str]], list[object]]:
    """Mark a provider's function as one from lists to lists."""
    call.takes_lists = True
    return call


def ask(call: Callable, texts: list[str], size: int = LIST_SIZE) -> list[tuple[object, str | None]]:
    """Result and error of every text. A call that fails as a whole, or answers with another number of results,
    fails all its texts."""
    out: list[tuple[object, str | None]] = []
    if not getattr(call, "takes_lists", False):
        for text in texts:
            try:
                out.append((call(text), None))
            except Exception as problem:  # a provider may raise anything
                out.append((None, str(problem)))
        return out
    for at in range(0, len(texts), size):
        part = texts[at : at + size]
        try:
            results = list(call(part))
            if len(results) != len(part):
                raise ValueError(f"{len(results)} results for {len(part)} texts")
            out += [(None, str(r)) if isinstance(r, Exception) else (r, None) for r in results]
        except Exception as problem:
            out += [(None, str(problem))] * len(part)
    return out


def attempts(call: Callable, texts: list[str], waits: list[float], gate=None, size: int = LIST_SIZE) -> list[tuple[object, str | None, int]]:
    """Result, error and number of attempts of every text; ``waits`` are the pauses between attempts, each made once
    for all texts that failed."""
    found: list[tuple[object, str | None, int]] = [(None, None, 0)] * len(texts)
    queue = list(range(len(texts)))
    for number in range(len(waits) + 1):
        if not queue:
            break
        if number and waits[number - 1] > 0:
            time.sleep(waits[number - 1])
        failed = []
        for i, (result, error) in zip(queue, ask(call, [texts[i] for i in queue], size)):
            if error is None and gate:
                try:
                    error = gate(result)
                except Exception as problem:
                    error = str(problem)
            found[i] = (result if error is None else None, error, number + 1)
            if error is not None:
                failed.append(i)
        queue = failed
    return found


def attempt(call: Callable, text: str, waits: list[float], gate=None) -> tuple[object, str | None, int]:
    """``attempts`` of one text."""
    if getattr(call, "takes_lists", False):
        return attempts(call, [text], waits, gate)[0]
    return attempts(lists(lambda texts: [call(t) for t in texts]), [text], waits, gate)[0]


def _schema(df: DataFrame, added: dict[str, str]) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in added]
    extra = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in added.items()]
    return T.StructType([*kept, *extra])


def score(
    df: DataFrame,
    provider: Provider | None,
    in_col: str = "original_text",
    out_col: str = "translated_text",
    max_retries: int = 3,
    on_fail: str = "input",
    pause: str | None = "linear",
    gate: Callable[[object], str | None] | None = None,
    out_type: str = "string",
    list_size: int = LIST_SIZE,
) -> DataFrame:
    """Add ``out_col``, ``status``, ``attempts`` and ``error``.

    Rows without input and rows already failed are skipped.  After the last failed attempt the
    row keeps its input (``on_fail='input'``) or is marked failed (``'error'``).  Without a
    provider the input is the result.
    """
    if on_fail not in ("input", "error"):
        raise ValueError(f"unknown on_fail {on_fail!r}")
    schema = _schema(df, {out_col: out_type, "status": "string", "attempts": "int", "error": "string"})
    if provider is None:
        status = F.col("status") if "status" in df.columns else F.lit(None).cast("string")
        failed = F.coalesce(status == "failed", F.lit(False))
        use = (F.length(F.coalesce(in_col, F.lit(""))) > 0) & ~failed
        previous = F.col(out_col) if out_col in df.columns else F.lit(None).cast(out_type)
        error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
        return df.withColumns({
            out_col: F.when(use, F.col(in_col)).otherwise(previous),
            "status": F.when(use, "translated").otherwise(status),
            "attempts": F.lit(0),
            "error": error,
        }).select(*[f.name for f in schema.fields])
    waits = backoff(pause, max_retries) if pause else [0.0] * max(0, max_retries - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = provider()
        for batch in batches:
            size = len(batch)
            outs = list(batch[out_col]) if out_col in batch else [None] * size
            states = list(batch["status"]) if "status" in batch else [None] * size
            errors = list(batch["error"]) if "error" in batch else [None] * size
            tries = [0] * size
            texts = batch[in_col].tolist()
            todo = [i for i, text in enumerate(texts) if isinstance(text, str) and text and states[i] != "failed"]
            for i, (result, problem, tries[i]) in zip(todo, attempts(call, [texts[i] for i in todo], waits, gate, list_size)):
                if problem is None:
                    outs[i] = result.strip() if isinstance(result, str) else result
                    states[i] = "translated"
                elif on_fail == "input":
                    outs[i], states[i] = texts[i], "translated"
                else:
                    outs[i], states[i], errors[i] = None, "failed", problem
            batch = batch.assign(**{out_col: pd.Series(outs, dtype=object, index=batch.index), "status": states, "attempts": tries, "error": errors})
            yield batch[[f.name for f in schema.fields]]

    return df.mapInPandas(run, schema)


def copy_texts(df: DataFrame, in_col: str = "original_text", out_col: str = "translated_text") -> DataFrame:
    """The result where source and target language are the same: every row, also an empty or failed one, takes its
    input and counts as translated."""
    return df.withColumns({out_col: F.col(in_col), "status": F.lit("translated")})


def route_scores(
    df: DataFrame,
    registry: dict[str, Provider],
    in_col: str = "translated_text",
    out_col: str = "result",
    engine_col: str = "engine",
    sample_col: str = "voice_sample",
    needs_sample: dict[str, bool] | None = None,
    default: str = K.DEFAULT_ENGINE,
    fallback: dict[str, str] | None = None,
    out_type: str = "string",
    list_size: int = LIST_SIZE,
) -> DataFrame:
    """Score each row by the engine it names; ``status`` is ok or error.

    Engines that clone a voice need a sample.  A processor error of an engine in ``fallback``
    moves the row to its second engine.  The rows of a batch are asked engine by engine, those moved at the end.
    """
    rules = K.ENGINES if needs_sample is None else needs_sample
    schema = _schema(df, {out_col: out_type, "engine_used": "string", "status": "string", "error": "string"})
    cpu_words = K.CPU_ERROR_WORDS_LONG
    second = fallback or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[str, Callable[[str], object]] = {}

        def answers(wanted: dict[str, list[int]], texts: list) -> Iterator[tuple[str, int, object, str | None]]:
            for engine, rows in wanted.items():
                if engine not in built:
                    try:
                        built[engine] = registry[engine]()
                    except Exception as problem:
                        yield from ((engine, i, None, str(problem)) for i in rows)
                        continue
                for i, (result, error) in zip(rows, ask(built[engine], [texts[i] for i in rows], list_size)):
                    yield engine, i, result, error

        for batch in batches:
            texts, size = batch[in_col].tolist(), len(batch)
            outs, engines, states, errors = [None] * size, [""] * size, ["error"] * size, [None] * size
            wanted: dict[str, list[int]] = {}
            moved: dict[str, list[int]] = {}
            for i, (engine, sample) in enumerate(zip(batch[engine_col], batch[sample_col])):
                engines[i] = engine = engine.lower() if isinstance(engine, str) and engine else default
                if engine not in registry:
                    errors[i] = f"Unknown engine: {engine}"
                elif rules.get(engine) and not (isinstance(sample, str) and sample):
                    errors[i] = f"{engine} requires a reference sample"
                else:
                    wanted.setdefault(engine, []).append(i)
            for engine, i, result, error in answers(wanted, texts):
                other = second.get(engine)
                if error is None:
                    outs[i], states[i] = result, "ok"
                elif other in registry and any(w in error.lower() for w in cpu_words):
                    moved.setdefault(other, []).append(i)
                else:
                    errors[i] = error
            for engine, i, result, error in answers(moved, texts):
                engines[i] = engine
                outs[i], states[i], errors[i] = (result, "ok", None) if error is None else (None, "error", error)
            batch = batch.assign(**{out_col: pd.Series(outs, dtype=object, index=batch.index), "engine_used": engines, "status": states, "error": errors})
            yield batch[[f.name for f in schema.fields]]

    return df.mapInPandas(run, schema)


def resume_scores(
    df: DataFrame, path: str, provider: Provider | None, keys: list[str], batches: int = 16, retry_failed: bool = False, **options,
) -> DataFrame:
    """Score only the rows that the table at ``path`` does not hold yet, add them to it, return the table.

    Rows are dealt by the hash of their keys to ``batches`` batches, and each batch is committed to a folder of
    its own before the next begins: a stopped call loses one batch at most, and the next call scores the
    rest.  With ``retry_failed`` rows that ended as failed are scored again; of a row's results the latest counts.
    """
    spark = df.sparkSession
    schema = T.StructType([*score(df, provider, **options).schema, T.StructField("saved_at", T.LongType())])

    def table() -> DataFrame:
        # A folder that a stopped call left without any file has no schema to infer.
        held = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
        newest = held.groupBy(*keys).agg(F.max("saved_at").alias("saved_at"))
        return held.join(newest, [*keys, "saved_at"], "left_semi")

    done = table().where(F.coalesce(F.col("status") != "failed", F.lit(True))) if retry_failed else table()
    turn = time.time_ns()
    # The rows to do are fixed before the first batch changes the table.
    pending = df.join(done.select(*keys), keys, "left_anti").withColumn("__batch", F.pmod(F.xxhash64(*keys), F.lit(batches)))
    checkpoint_dir(spark)
    pending = pending.checkpoint()
    for batch in range(batches):
        rows = pending.where(F.col("__batch") == batch).drop("__batch")
        if retry_failed and "status" in df.columns:
            rows = rows.withColumn("status", F.nullif("status", F.lit("failed")))
        scored = score(rows, provider, **options).withColumn("saved_at", F.lit(turn))
        scored.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{turn}-{batch}")
    return table().drop("saved_at")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def analyze(segments: DataFrame, mode: str, provider: Provider | None, task_chars: int = TASK_CHARS, **options) -> DataFrame:
    """Whole transcript of each recording, the prompt for ``mode`` and the provider's one answer to it.

    A prompt is one value, so the parts of a long recording's text are put together again, in order.  Recordings are
    dealt to tasks by their text, which is measured first: what a Python worker holds is about ``task_chars`` characters
    of transcripts, or a single longer one.
    """
    chars = segments.agg(F.sum(F.length("original_text"))).first()[0]
    dealt = spread(concat_text(segments), ["task_id"], rows=chars or 0, most=task_chars)
    listed = F.array_sort(F.collect_list(F.struct("part", "text")))
    texts = dealt.groupBy("task_id").agg(F.array_join(F.transform(listed, lambda p: p["text"]), " ").alias("text"))
    prompted = texts.withColumns({
        "prompt": X.analysis_prompt(F.col("text"), F.lit(mode)),
        "error": X.analysis_error(F.lit(mode)),
    })
    return score(prompted, provider, "prompt", "analysis", on_fail="error", **options)
