"""Embeddings: normalization, distances to groups, silhouette, speaker clustering.

Cosine distances between groups only need the sum of the unit vectors of each group: the mean
distance from a to group G is 1 - a.sum(G)/|G|.  So nothing here lists the pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.vectors import cosine_distance, dot, l2_normalize
from voxlake.plans.lookup import attach


def normalize(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    return embeddings.withColumn(vector, l2_normalize(F.col(vector)))


def group_sums(unit: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Count and sum of the vectors of each group: one aggregate over whole vectors, whose buffers combine before
    the shuffle. The vectors have one size and no missing components."""
    whole = Summarizer.sum(array_to_vector(F.col(vector).cast("array<double>")))
    given = unit.where(F.col(vector).isNotNull())
    return given.groupBy(*by).agg(F.count("*").alias("n"), whole.alias("total")).withColumn("total", vector_to_array("total"))


def pair_distances(embeddings: DataFrame, pairs: DataFrame, by: str = "task_id") -> DataFrame:
    """Cosine distance of asked pairs (task_id, left_idx, right_idx)."""
    side = embeddings.select(by, "idx", "embedding")
    left = side.select(by, F.col("idx").alias("left_idx"), F.col("embedding").alias("__l"))
    right = side.select(by, F.col("idx").alias("right_idx"), F.col("embedding").alias("__r"))
    joined = pairs.join(left, [by, "left_idx"]).join(right, [by, "right_idx"])
    return joined.withColumn("distance", cosine_distance(F.col("__l"), F.col("__r"))).drop("__l", "__r")


def _with_groups(unit: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Each vector with the sums of all groups of its recording (as many as there are labels)."""
    sums = group_sums(unit, [*by, label])
    groups = sums.groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("label"), "n", "total")).alias("__groups"))
    return attach(unit, groups, by)


def mean_distances(embeddings: DataFrame, label: str = "label", by: str = "task_id") -> DataFrame:
    """Mean cosine distance of every vector to every labelled group of its recording, itself left out."""
    unit = normalize(embeddings)
    rows = _with_groups(unit, label, [by]).withColumn("__g", F.explode("__groups"))
    own = F.col("__g.label").eqNullSafe(F.col(label))
    total = F.col("__g.n") - dot(F.col("embedding"), F.col("__g.total"))
    others = F.col("__g.n") - F.when(own, 1).otherwise(0)
    return rows.select(
        by, "idx", F.col("__g.label").alias("group_label"), others.alias("others"),
        F.try_divide(total, others.cast("double")).alias("mean_distance"),
    )


def silhouette_points(embeddings: DataFrame, label: str = "label", by: str = "task_id") -> DataFrame:
    """Silhouette of each vector; 0 for a group of one or where there is only one group."""
    unit = normalize(embeddings)
    rows = _with_groups(unit, label, [by])
    # The sums make the distances: (n - a.S) adds up 1 - a.b over the group, the own term being 0.
    spread = F.transform(
        "__groups",
        lambda g: F.struct(g["label"].alias("label"), g["n"].alias("n"), (g["n"] - dot(F.col("embedding"), g["total"])).alias("d")),
    )
    rows = rows.withColumn("__spread", spread)
    own = F.filter("__spread", lambda g: g["label"].eqNullSafe(F.col(label)))[0]
    inside = F.try_divide(own["d"], (own["n"] - 1).cast("double"))
    outside = F.array_min(
        F.transform(F.filter("__spread", lambda g: ~g["label"].eqNullSafe(F.col(label))), lambda g: g["d"] / g["n"])
    )
    score = F.try_divide(outside - inside, F.greatest(inside, outside))
    return rows.select(by, "idx", label, F.coalesce(score, F.lit(0.0)).alias("silhouette"))


def silhouette(embeddings: DataFrame, label: str = "label", by: str = "task_id") -> DataFrame:
    """Mean silhouette of each recording's grouping."""
    return silhouette_points(embeddings, label, by).groupBy(by).agg(F.avg("silhouette").alias("silhouette"))


DIGITS = 12  # distances are compared rounded, so that the order in which sums were added plays no part
BLOCK = 1024


def closest(total: np.ndarray, count: np.ndarray, rows: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``rows`` the nearest other of the ``alive`` clusters (ascending rows) and its distance; of equal
    ones the smallest row."""
    near, dist = np.empty(len(rows), np.int64), np.empty(len(rows))
    for at in range(0, len(rows), BLOCK):
        own = rows[at : at + BLOCK]
        d = np.round(1.0 - (total[own] @ total[alive].T) / np.outer(count[own], count[alive]), DIGITS)
        d[np.arange(len(own)), np.searchsorted(alive, own)] = np.inf
        best = d.argmin(axis=1)
        near[at : at + BLOCK], dist[at : at + BLOCK] = alive[best], d[np.arange(len(own)), best]
    return near, dist


def average_link(sums: np.ndarray, sizes: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges (a, b) of rows, their heights and rounds; a cluster goes on under the smaller of its two rows.

    In a round all pairs are joined that are each other's nearest cluster: by distance, then by the smaller row.
    The nearest cluster of a cluster is remembered, and searched again only where it was merged: average linkage
    never brings a joined cluster nearer than the nearer of its parts. Works on vector sums, so it keeps n vectors
    and no distance matrix. A cluster is never lower than what it is made of (``low`` at the start), whatever
    rounding says.
    """
    n = len(sums)
    total, count = sums.astype(float).copy(), sizes.astype(float).copy()
    height = np.full(n, -1.0) if low is None else low.astype(float).copy()
    near, dist = np.zeros(n, np.int64), np.zeros(n)
    alive = stale = np.arange(n)
    merges, heights, rounds = [], [], []
    while len(alive) > 1:
        near[stale], dist[stale] = closest(total, count, stale, alive)
        a = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        b = near[a]
        if not len(a):  # rounding left no such pair: the closest one
            low_row, high_row = np.minimum(alive, near[alive]), np.maximum(alive, near[alive])
            at = np.lexsort((high_row, low_row, dist[alive]))[:1]
            a, b = low_row[at], high_row[at]
            dist[a] = dist[alive][at]
        height[a] = np.maximum(np.maximum(height[a], height[b]), dist[a])
        merges.append(np.stack([a, b], axis=1))
        heights.append(height[a])
        rounds.append(np.full(len(a), len(rounds)))
        total[a] += total[b]
        count[a] += count[b]
        merged, gone = np.zeros(n, bool), np.zeros(n, bool)
        gone[b] = merged[a] = merged[b] = True
        alive = alive[~gone[alive]]
        stale = alive[merged[near[alive]] | merged[alive]]
    if not merges:
        return np.zeros((0, 2), np.int64), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(merges), np.concatenate(heights), np.concatenate(rounds)


def cut_tree(n: int, merges: np.ndarray, heights: np.ndarray, rounds: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters: every merge but the k - 1 highest (of equal ones the later round, then the larger row),
    numbered by first appearance."""
    root = np.arange(n)
    keep = np.lexsort((merges[:, 0], rounds, heights))[: max(0, n - k)] if len(merges) else []
    for i in np.sort(keep):
        root[merges[i, 1]] = merges[i, 0]
    for i in range(n):  # a cluster's row is its smallest, so it is settled before the others
        root[i] = root[root[i]]
    return np.unique(root, return_inverse=True)[1]


def weighted_silhouette(unit_sums: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> float:
    """Mean cosine silhouette of unit vectors from the sums of their groups."""
    k = len(unit_sums)
    n = np.bincount(labels, minlength=k).astype(float)
    spread = n[None, :] - vectors @ unit_sums.T
    rows = np.arange(len(vectors))
    own = n[labels]
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = spread[rows, labels] / (own - 1)
        away = spread / n[None, :]
        away[rows, labels] = np.inf
        outside = away.min(axis=1)
        score = (outside - inside) / np.maximum(inside, outside)
    return round(float(np.where(own > 1, np.nan_to_num(score), 0.0).mean()), DIGITS)


def choose_labels(vectors: np.ndarray, max_k: int, margin: float, floor: float) -> np.ndarray:
    """Speaker of each unit vector of one recording.

    A larger number of speakers is only taken when its silhouette is better by ``margin``; below
    ``floor`` there is one speaker.
    """
    n = len(vectors)
    labels = np.zeros(n, dtype=np.int64)
    if n < 3:
        return labels
    tree = average_link(vectors, np.ones(n))
    best = -1.0
    for k in range(2, min(n - 1, max_k) + 1):
        tried = cut_tree(n, *tree, k)
        sums = np.zeros((k, vectors.shape[1]))
        np.add.at(sums, tried, vectors)
        score = weighted_silhouette(sums, vectors, tried)
        if score > best + margin:
            best, labels = score, tried
    return labels if best >= floor else np.zeros(n, dtype=np.int64)


def cluster_speakers(
    embeddings: DataFrame, by: str = "task_id", max_k: int = 10, margin: float = 0.15, floor: float = 0.4,
    local_rows: int = 4096,
) -> DataFrame:
    """(by, idx, speaker_id): average-link cosine clustering of each recording's vectors.

    Recordings of up to ``local_rows`` vectors are clustered inside one task each; larger ones go
    through ``voxlake.operators.bigcluster``, which joins the same pairs in the same rounds with many tasks:
    distances count rounded to DIGITS on both sides, and of equal ones the smaller ``idx``. Rows without a vector,
    or with a missing or non-finite component, have no speaker.
    """
    types = dict(embeddings.dtypes)
    vector = F.col("embedding").cast("array<double>")
    whole = F.coalesce(~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    unit = embeddings.where(whole).select(by, "idx", vector.alias("embedding"))
    sizes = unit.groupBy(by).agg(F.count("*").alias("__n"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        vectors = np.stack(pdf["embedding"].to_numpy())
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, length, out=vectors.copy(), where=length > 0)
        return pd.DataFrame({
            by: pdf[by].to_numpy(), "idx": pdf["idx"].to_numpy(), "speaker_id": choose_labels(vectors, max_k, margin, floor)
        })

    schema = f"{by} {types[by]}, idx {types['idx']}, speaker_id int"
    large = sizes.where(F.col("__n") > local_rows).select(by)
    if not large.take(1):
        return unit.groupBy(by).applyInPandas(assign, schema)
    from voxlake.operators.bigcluster import cluster_large

    small = unit.join(large, by, "left_anti").groupBy(by).applyInPandas(assign, schema)
    return small.unionByName(cluster_large(unit.join(large, by, "left_semi"), by, max_k, margin, floor, local_rows))


def assign_speakers(segments: DataFrame, embeddings: DataFrame, **options) -> DataFrame:
    """Segments with the speaker of their embedding; segments without one get speaker 0."""
    found = cluster_speakers(embeddings, "task_id", **options).withColumnRenamed("speaker_id", "__speaker")
    out = segments.join(found, ["task_id", "idx"], "left")
    return out.withColumn("speaker_id", F.coalesce("__speaker", F.lit(0))).drop("__speaker")
