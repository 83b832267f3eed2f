import hashlib
import math

import numpy as np
import pytest
from rows import FOLDER
from voxlake.llm import simplex
from voxlake.llm.simplex import centroid_clusters

LONG = 1 << 63


def integers(v):
    return [math.floor(1024 * x) if abs(x) < 1e300 else 1024 * int(x) for x in v]


def plain(rows, clusters, rounds, size):
    """Lloyd's rounds on Python integers."""
    kept = [(i, integers(v), v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v, _ in sorted(kept, key=lambda r: (mark(r[0]), r[2]))[:clusters]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [min((away(v, c), k) for k, c in enumerate(centroids)) for _, v, _ in kept]

    for _ in range(rounds):
        own = [[v for (_, v, _), (_, k) in zip(kept, told) if k == c] for told in [assigned()] for c in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(own, centroids)]
    told = assigned()
    total = sum(d for d, _ in told)
    within = {k: sum(d for d, j in told if j == k) for _, k in told}
    long = lambda v: v if v < LONG else None
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, k, long(d), long(within[k]), long(total), sha(centroids[k])) for (i, _, _), (d, k) in zip(kept, told)), key=repr)


def result(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, 9, 1.0) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, x double")


def test_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [float("nan"), 0.0, 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, [0.5] * 4), (None, [0.25] * 4), (200, [0.0] * 4), (201, [0.0] * 4), (202, [-0.0001] * 4)]
    assert result(centroid_clusters(frame(spark, rows), 5, 6, 4)) == plain(rows, 5, 6, 4)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    assert result(centroid_clusters(frame(spark, rows), 8, 4, 2)) == plain(rows, 8, 4, 2)
    same = [(i, [1.0, 1.0]) for i in range(9)]
    assert result(centroid_clusters(frame(spark, same), 8, 3, 2)) == plain(same, 8, 3, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 1.5]), (2, [2.5, -1.5])]
    assert result(centroid_clusters(frame(spark, rows), 8, 3, 2)) == plain(rows, 8, 3, 2)
    assert result(centroid_clusters(frame(spark, [(1, None)]), 8, 3, 2)) == []


def test_components_that_64_bits_cannot_square(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (i % 12)).tolist()) for i in range(40)] + [(99, [1e30, -1e25, 3.0]), (98, [1e30, -1e25, 4.0])]
    assert result(centroid_clusters(frame(spark, rows), 4, 5, 3)) == plain(rows, 4, 5, 3)


def test_table_and_what_bounds_save(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.select("vec_id", "embedding").collect()]
    out = centroid_clusters(table, 8, 10, 64)
    assert result(out) == plain(rows, 8, 10, 64)


def test_bounds_leave_out_centroids_but_never_the_nearest():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(8, 64)) * 3
    x = simplex.to_integers(np.concatenate([m + rng.normal(size=(200, 64)) * 0.1 for m in middles]))
    pivots = simplex.choose_pivots(x[::200].tolist())
    assert len(pivots.points) == simplex.PIVOTS
    apex = simplex.apexes(simplex._to_pivots(x, pivots), pivots)
    centroids = x[7::200]
    cluster, best, compared = simplex.nearest(x, apex, centroids, simplex.apexes(simplex._to_pivots(centroids, pivots), pivots))
    exact = ((x[:, None, :] - centroids[None]) ** 2).sum(-1)
    assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert compared < 2 * len(x)


@pytest.mark.parametrize("m", [1, 3, 6])
def test_apexes_bound_distances(m):
    rng = np.random.default_rng(m)
    x = rng.integers(-1000, 1000, (50, 10))
    pivots = simplex.choose_pivots(x[:m].tolist(), m)
    apex = simplex.apexes(simplex._to_pivots(x, pivots), pivots)
    true = ((x[:, None] - x[None]) ** 2).sum(-1)
    feet = ((apex[:, None, :-1] - apex[None, :, :-1]) ** 2).sum(-1)
    low, high = (feet + (apex[:, None, -1] + s * apex[None, :, -1]) ** 2 for s in (-1, 1))
    assert (low <= true * (1 + 1e-9) + 1e-3).all() and (high >= true * (1 - 1e-9) - 1e-3).all()
