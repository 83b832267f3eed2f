"""Quality rules: document statistics, hard floors, and boosted trees over the statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.trees import FlatTrees, fit_trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and the direction in which they may move the score.
FEATURES = {
    "log_words": 1, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": 0,
    "digit_share": 0, "mark_share": 0, "mean_line": 0, "long_word_share": 0, "most_common_share": 0, "end_mark_share": 0, "other_share": 0,
}
MARKS, DIGITS = ".,;:!?", "0123456789"


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts of a text and its features, from the whole text."""
    words = WORD.findall(text)
    n = len(words)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        # Both numbers fit: ids are below n, and pairs are numbered anew before the third word joins them.
        _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        _, which, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        twice = np.nonzero(count[which] >= 2)[0]
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[twice + k] = True
        repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    counts = [n, chars, symbols, len(lines) - len(set(lines)), repeated]
    most, size = max(n, 1), max(chars, 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper = sum(w[0].isupper() for w in words)
    features = [
        float(np.log1p(n)), chars / most, symbols / size, counts[3] / max(len(lines), 1), repeated / most, len(seen) / most, upper / most,
        sum(map(text.count, DIGITS)) / size, sum(map(text.count, MARKS)) / size, n / max(len(lines), 1), float((lengths > 15).mean()) if n else 0.0,
        float(np.bincount(ids).max() / n) if n else 0.0, sum(x.rstrip()[-1] in ".!?" for x in lines) / max(len(lines), 1),
        sum(w.isupper() and len(w) > 1 for w in words) / most,
    ]
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FlatTrees:
    """Trees learned from at most ``sample_rows`` labelled documents, those with the smallest hash of their id
    (with fewer, from all). Only their features reach the driver, ``len(FEATURES)`` numbers each."""
    chosen = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("y")).dropna()
        .dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t or "")[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = texts.mapInArrow(run, "id long, y double, x array<double>").toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit_trees(x, got["y"].to_numpy(float), np.array(list(FEATURES.values())))


def rate_quality(docs: DataFrame, model: FlatTrees, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, the base counts, ``base_failed``, ``kept`` and ``quality``.

    A document is kept unless it has fewer than 50 words, repeats more than half of its words in 3-word
    windows, or the trees give it less than ``keep_from``. The score can only fall with more symbols, repeated
    lines or repeated words, and only rise with more words. Null and empty texts have no words and fail the
    base rule; repeated rows give repeated rows; an empty table gives none. Nothing is shuffled; the model
    travels with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [statistics(t or "") for t in batch.column(1).to_pylist()]
            counts, score = np.array([c for c, _ in found], np.int64), model.score(np.array([f for _, f in found]))
            failed = base_failed(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[:, i]) for i in range(5)], pa.array(failed), pa.array(~failed & (score >= keep_from)), pa.array(score)],
                [id_col, *COUNTS, "base_failed", "kept", "quality"],
            )

    schema = f"{id_col} long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, quality double"
    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, schema)
