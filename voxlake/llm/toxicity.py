"""Toxicity of texts after undoing disguises."""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.noisy import KEPT_EDGES, SIZE, Restorer, language_model, trigram_counts
from voxlake.llm.tables import saved
from voxlake.llm.trees import FlatTrees, fit_trees

STEMS = (4, 5, 6)
N_FEATURES = 7


@dataclass
class ToxicityModel:
    """What scoring needs: the character model, weights of terms, and the trees over a text's evidence."""

    letters: np.ndarray
    weights: dict[str, float]
    trees: FlatTrees | None = None


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Reader:
    """The terms of a text's restored words. Tokens repeat, so what a token gives is kept (bounded)."""

    def __init__(self, letters: np.ndarray, weights: dict[str, float] | None = None) -> None:
        self.restorer, self.weights = Restorer(letters), weights
        self.known: dict[str, tuple] = {}

    def _read(self, token: str) -> tuple:
        words, restored = self.restorer.read(token)
        if self.weights is None:
            return tuple({t for readings in words for w in readings for t in terms(w)})
        best = (max((self.weights.get(t, 0.0) for w in readings for t in terms(w)), default=0.0) for readings in words)
        found = tuple(b for b in best if b > 0)
        if restored and found and (plain := token.strip(KEPT_EDGES)).isalpha():  # a doubled letter may be the plain word's own
            restored = max(self.weights.get(t, 0.0) for t in terms(plain)) < max(found)
        return found, restored

    def tokens(self, text: str) -> tuple[Counter, list[list[str]]]:
        low = text.lower()
        found = Counter(low.split())
        if len(self.known) > 400_000:
            self.known.clear()
        for t in found:
            if t not in self.known:
                self.known[t] = self._read(t)
        return found, self.restorer.spaced(low)

    def terms(self, text: str) -> set[str]:
        found, spaced = self.tokens(text)
        return {x for t in found for x in self.known[t]} | {x for readings in spaced for w in readings for x in terms(w)}

    def features(self, text: str) -> list[float]:
        """Evidence: words found, their weights, their share of the text, and how many were disguised."""
        found, spaced = self.tokens(text)
        hits = [((best, self.known[t][1]), n) for t, n in found.items() for best in self.known[t][0]]
        hits += [((best, True), 1) for readings in spaced if (best := max(self.weights.get(t, 0.0) for w in readings for t in terms(w))) > 0]
        own = sorted((w for (w, _), _ in hits), reverse=True)
        total, words = sum(n for _, n in hits), sum(found.values())
        return [
            float(len(own)), own[0] if own else 0.0, own[1] if len(own) > 1 else 0.0, sum(own), float(total), 100.0 * total / max(words, 1),
            float(sum(n for (_, restored), n in hits if restored)),
        ]


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for begin in range(0, batch.num_rows, 128):
            trigram_counts(" ".join(t or "" for t in batch.column(0).slice(begin, 128).to_pylist()), counts)
    at = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])


def learn_letters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The character model of all texts; SIZE ** 3 counts at most come to the driver."""
    rows = docs.select(text_col).mapInArrow(_letters, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3, np.int64)
    for r in rows:
        counts[r.gram] = r.n
    return language_model(counts)


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, least_docs: int = 5, least_ratio: float = 6.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> ToxicityModel:
    """A model from at most ``sample_rows`` labelled documents (those with the smallest hash of their id) outside
    the held-out third; the character model comes from all texts.

    Half of the sample gives the terms: words and beginnings of words that at least ``least_docs`` toxic
    texts have, ``least_ratio`` times as often as the others. Equal texts count once. The other half fits the
    trees over the evidence, which can only rise with more of it. A sample without toxic texts, or
    without any, gives a constant low score."""
    letters = learn_letters(docs, text_col)
    chosen = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).dropna().filter(~held_out(F.col("id")))
        .dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    sample = saved(
        docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id").filter("text is not null")
        .dropDuplicates(["text"]).select("id", "y", "text", (F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)) == 0).alias("first")),
        "labelled")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(letters)

    def count(label: int, wanted=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, seen = Reader(sent.value), Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    own = reader.terms(text)
                    seen.update(own if wanted is None else own & wanted.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        return sample.filter(F.col("first") & (F.col("y") == label)).select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    sizes = {r.y: r.n for r in sample.filter("first").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = {r.term: r.n for r in count(1).filter(F.col("n") >= least_docs).collect()}  # bounded by the sample
    clean = {r.term: r.n for r in count(0, spark.sparkContext.broadcast(frozenset(toxic))).collect()}
    weights = {}
    for term, n in toxic.items():
        ratio = ((n + 0.5) / (sizes.get(1, 0) + 1)) / ((clean.get(term, 0) + 0.5) / (sizes.get(0, 0) + 1))
        if ratio >= least_ratio:
            weights[term] = float(np.log(ratio))
    model = ToxicityModel(letters, weights)
    got = _evidence(sample.filter("not first").select("id", "text", "y"), model).toPandas().sort_values(["id", "y"], kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), N_FEATURES)
    model.trees = fit_trees(x, got["y"].to_numpy(float), np.ones(N_FEATURES), trees=60, depth=3, without_rows=0.0)
    return model


def _evidence(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((model.letters, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*sent.value)
        for batch in batches:
            found = [reader.features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["id", "y", "x"])

    return rows.select(F.col("id").cast("long").alias("id"), "text", F.col("y").cast("int").alias("y")).mapInArrow(run, "id long, y int, x array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "toxicity", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out``: the probability that the text is toxic, from the whole text alone.

    Tokens in which letters are replaced, repeated or set apart, and runs of single letters, are decoded at any
    length by Viterbi over their lattice of readings under the character model; the evidence of the restored words
    goes through the trees. Null and empty texts have no evidence. Every row stays, repeated ones too; other
    columns pass unchanged; an empty table gives an empty one. Nothing is shuffled.
    """
    # Plain arrays and numbers: what is broadcast is pickled by reference, and workers need no copy of the package.
    parts = tuple(vars(model.trees).values())
    sent = docs.sparkSession.sparkContext.broadcast((model.letters, model.weights, parts))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters, weights, parts = sent.value
        reader, trees = Reader(letters, weights), FlatTrees(*parts)
        for texts in batches:
            x = np.array([reader.features(t or "") for t in texts], float).reshape(len(texts), N_FEATURES)
            yield pd.Series(trees.score(x))

    return docs.withColumn(out, score(F.col(text_col)))
