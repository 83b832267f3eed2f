"""Clustering of integer vectors around centroids, with n-simplex projection to leave out most comparisons.

The distances of a vector to a few pivots are computed once. They place the vector as the apex of a simplex over
the pivots: its foot in the space that the pivots span, and its height above it. The distance of two apexes on
the same side is never more, and on opposite sides never less, than the true distance. So the centroids whose
lower bound is above the smallest upper bound need no comparison, and the others are compared in exact integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tables import saved

SCALE = 1024
PIVOTS = 6
SMALL = float(1 << 17)  # components below it have squared distances that fit 64 bits easily; others are Python integers
FLAT = 0.05  # a pivot closer than this share of its distance to the span of the others is left out
SLACK = 1e-6  # of the squared lengths involved; far above what rounding does to bounds
LONG = 1 << 63
PART = 4096  # vectors of one numpy step


def _whole(x: float) -> int:
    return math.floor(SCALE * x) if abs(x) < 1e300 else SCALE * int(x)


def to_integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit numbers, or Python integers where they could grow too large to square."""
    if not x.size or np.abs(x).max() < SMALL:
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([[_whole(v) for v in row] for row in x.tolist()], object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of ``a`` and ``b``, pair by pair."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(-1)


@dataclass(frozen=True)
class Pivots:
    """The pivots, and the triangular matrix that turns distances to them into coordinates."""

    points: list[list[int]]
    base: np.ndarray
    lengths: np.ndarray


def choose_pivots(points: list[list[int]], most: int = PIVOTS) -> Pivots:
    """Of the given vectors the first ones that span a simplex which isn't flat."""
    chosen, base = points[:1], np.zeros((0, 0))
    for p in points[1:]:
        if len(chosen) >= most:
            break
        own = [float(squared(np.array(p, object), np.array(q, object))) for q in chosen]
        lengths = (base * base).sum(1)
        foot = np.linalg.solve(base, (own[0] + lengths - np.array(own[1:])) / 2) if len(base) else np.zeros(0)
        rest = own[0] - float(foot @ foot)
        if own[0] > 0 and rest > (FLAT**2) * own[0]:
            chosen = [*chosen, p]
            base = np.block([[base, np.zeros((len(base), 1))], [foot[None, :], np.array([[math.sqrt(rest)]])]])
    return Pivots(chosen, base, (base * base).sum(1))


def apexes(distances: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Coordinates (foot, then height) from squared distances to the pivots, a row a vector."""
    first = distances[:, :1].astype(float)
    right = (first + pivots.lengths[None, :] - distances[:, 1:].astype(float)) / 2
    foot = np.linalg.solve(pivots.base, right.T).T if len(pivots.base) else right
    height = np.sqrt(np.maximum(first[:, 0] - (foot * foot).sum(1), 0.0))
    return np.concatenate([foot, height[:, None]], 1)


def _to_pivots(x: np.ndarray, pivots: Pivots) -> np.ndarray:
    return np.stack([squared(x, np.array(p, x.dtype if max(map(abs, p)) < LONG else object)) for p in pivots.points], 1)


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every vector its nearest centroid (of equal ones the first), the exact squared distance, and how many
    comparisons were made. A centroid within SLACK of the bounds is compared."""
    feet = ((apex[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(-1)
    low, high = (feet + (apex[:, None, -1] + sign * centres[None, :, -1]) ** 2 for sign in (-1, 1))
    slack = SLACK * ((apex * apex).sum(1)[:, None] + (centres * centres).sum(1)[None, :]) + 1e-6
    left_out = (low - slack) > (high + slack).min(1)[:, None]
    big = x.dtype == object or centroids.dtype == object
    best = np.full(len(x), -1, object if big else np.int64)
    cluster = np.zeros(len(x), np.int64)
    compared = 0
    for c in range(len(centroids)):
        rows = np.flatnonzero(~left_out[:, c])
        compared += len(rows)
        d = squared(x[rows], centroids[c])
        closer = (best[rows] < 0) | (d < best[rows])
        best[rows[closer]], cluster[rows[closer]] = d[closer], c
    return cluster, best, compared


def _vectors(column: pa.Array) -> np.ndarray:
    lists = column.to_numpy(zero_copy_only=False)
    return np.stack(lists).astype(np.float64) if len(lists) else np.zeros((0, 0))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, PART) for b in batches for i in range(0, b.num_rows, PART))


def _projected(pivots: Pivots) -> Callable:
    """Adds the cached distances' apex to every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = to_integers(_vectors(part.column(1)))
            apex = apexes(_to_pivots(x, pivots), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, apex.size + 1, apex.shape[1], dtype=np.int32)), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["vec", "x", "apex"])

    return run


def _read(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return to_integers(_vectors(part.column(1))), np.stack(part.column(2).to_numpy(zero_copy_only=False))


def _centre_arrays(centroids: list[list[int]], pivots: Pivots) -> tuple[np.ndarray, np.ndarray]:
    big = max(abs(v) for c in centroids for v in c) >= SMALL * SCALE
    points = np.array(centroids, object if big else np.int64)
    return points, apexes(_to_pivots(points, pivots), pivots)


def _sums(centroids: list[list[int]], pivots: Pivots) -> Callable:
    """Per task and cluster: count and component sums, as text so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, centres = _centre_arrays(centroids, pivots)
        counts, totals = [0] * len(points), [[0] * points.shape[1] for _ in points]
        for part in _parts(batches):
            x, apex = _read(part)
            cluster = nearest(x, apex, points, centres)[0]
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                counts[c] += len(own)
                totals[c] = [t + int(v) for t, v in zip(totals[c], own.sum(0))]
        used = [c for c in range(len(points)) if counts[c]]
        yield _sum_rows([(c, counts[c], totals[c]) for c in used])

    return run


def _sum_rows(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[str(v) for v in r[2]] for r in rows], pa.list_(pa.string()))],
        ["cluster", "n", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a cluster's tasks, one row a cluster."""
    held: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for c, n, total in zip(*(col.to_pylist() for col in batch.columns)):
            m, own = held.get(c, (0, [0] * len(total)))
            held[c] = (m + n, [a + int(b) for a, b in zip(own, total)])
    yield _sum_rows([(c, n, t) for c, (n, t) in sorted(held.items())])


SUM_SQL = "cluster int, n long, total array<string>"


def moved(projected: DataFrame, centroids: list[list[int]], pivots: Pivots) -> list[list[int]]:
    """The centroids after one round: the floored mean of their vectors; an empty one stays. What comes to the
    driver is one row a centroid."""
    sums = projected.mapInArrow(_sums(centroids, pivots), SUM_SQL).repartition("cluster").mapInArrow(_added, SUM_SQL)
    found = {r.cluster: [int(v) // r.n for v in r.total] for r in sums.collect()}
    return [found.get(c, centroid) for c, centroid in enumerate(centroids)]


def _assigned(centroids: list[list[int]], pivots: Pivots) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, centres = _centre_arrays(centroids, pivots)
        for part in _parts(batches):
            x, apex = _read(part)
            cluster, best, compared = nearest(x, apex, points, centres)
            shown = pa.array([v if v < LONG else None for v in best.tolist()], pa.int64()) if best.dtype == object else pa.array(best)
            share = np.full(len(x), compared / max(len(x), 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), shown, pa.array(share)], ["vec", "cluster", "distance", "compared"])

    return run


def usable(vector: str, size: int) -> Column:
    """True for vectors of ``size`` components, all present and finite."""
    x = F.col(vector)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(x) == size) & ~F.exists(x, bad), F.lit(False))


def centroid_clusters(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector that has exactly ``size`` components, none null or non-finite: ``id_col, cluster, distance``
    (squared, to its centroid), ``cluster_inertia, inertia, centroid_sha256`` and ``compared`` (exact comparisons per
    vector in its step, of ``clusters``).

    Components count as floor(1024 * x). The first centroids are the vectors with the smallest sha256 of
    ``seed:id`` (fewer vectors: all of them); they also give the pivots, PIVOTS at most. Distances to the pivots are
    computed once and saved as apex coordinates beside the vectors; every round reads these, leaves out what the
    bounds exclude and compares the rest exactly. Sums combine in the tasks; the driver holds the centroids only.

    Equal distances go to the smaller number. Repeated rows count each; a missing id hashes as an empty one, and
    of equal hashes the smaller vector comes first; equal first centroids leave the later one empty. Distances
    and sums that a long can't hold are null. No usable vector, no rows; other columns play no part.
    """
    kept = vectors.filter(usable(vector_col, size)).select(F.col(id_col).alias("vec"), F.col(vector_col).cast("array<double>").alias("x"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(mark, "x").limit(clusters).collect()
    kind = vectors.schema[id_col].dataType.simpleString()
    if not first:
        return kept.select(
            F.col("vec").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"),
            F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"), F.lit(0.0).alias("compared"))
    centroids = [[int(v) for v in row] for row in to_integers(np.array([r.x for r in first])).tolist()]
    pivots = choose_pivots(centroids)
    projected = saved(kept.mapInArrow(_projected(pivots), f"vec {kind}, x array<double>, apex array<double>"), "apexes")
    for _ in range(rounds):
        after = moved(projected, centroids, pivots)
        if after == centroids:  # nothing moves any more
            break
        centroids = after
    told = saved(projected.mapInArrow(_assigned(centroids, pivots), f"vec {kind}, cluster int, distance long, compared double"), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # One row a centroid.
    sums = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    whole, lost = sum(int(r.own or 0) for r in sums), any(r.lost for r in sums)
    long = lambda v, bad: None if bad or v >= LONG else v
    table = [(r.cluster, long(int(r.own or 0), r.lost), long(whole, lost), digests[r.cluster]) for r in sums]
    stats = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(stats), "cluster").select(F.col("vec").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def sql(clusters: int = 8, rounds: int = 10, size: int = 64, seed: str = "3") -> str:
    """The same for DuckDB, a round after the other."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {clusters}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, (near).c AS c, (near).d AS d FROM (
    SELECT k.vec_id, any_value(k.v) AS v, min({{'d': list_sum([(x - y) * (x - y) FOR x, y IN list_zip(k.v, m.v)]), 'c': m.c}}) AS near FROM kept k, c{r} m GROUP BY k.vec_id)
)""".replace("[(x - y) * (x - y) FOR x, y IN list_zip(k.v, m.v)]", "list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"))
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
    SELECT c, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) t(i) GROUP BY c, i) GROUP BY c) n ON n.c = o.c
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""
