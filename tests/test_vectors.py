import numpy as np
import pytest

from voxlake.operators import bigcluster as B
from voxlake.operators import vectors as V


def cosine(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return 1 - unit @ unit.T


def brute_tree(x, k):
    """Average linkage from the pairwise distances, joined one by one."""
    d = cosine(x)
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = min(
            ((np.mean([d[i, j] for i in a for j in b]), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q)
        )
        _, p, q = best
        groups[p] += groups.pop(q)
    labels = np.empty(len(x), dtype=int)
    for n, group in enumerate(sorted(groups, key=min)):
        labels[group] = n
    return labels


def brute_silhouette(x, labels):
    d, out = cosine(x), []
    for i in range(len(x)):
        mine = [j for j in range(len(x)) if labels[j] == labels[i] and j != i]
        if not mine:
            out.append(0.0)
            continue
        a = np.mean(d[i, mine])
        b = min(np.mean(d[i, labels == other]) for other in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def brute_speakers(x, max_k=10, margin=0.15, floor=0.4):
    labels, best = np.zeros(len(x), dtype=int), -1.0
    if len(x) < 3:
        return labels
    for k in range(2, min(len(x) - 1, max_k) + 1):
        tried = brute_tree(x, k)
        score = brute_silhouette(x, tried)
        if score > best + margin:
            best, labels = score, tried
    return labels if best >= floor else np.zeros(len(x), dtype=int)


def blobs(seed, sizes, dim=8, noise=0.25):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) + noise * rng.normal(size=(n, dim)) for n in sizes]
    out = np.concatenate(rows)
    return out[rng.permutation(len(out))]


CASES = {1: blobs(1, [1]), 2: blobs(2, [1, 1]), 3: blobs(3, [9, 8, 3]), 4: blobs(4, [12, 12], noise=0.1), 5: blobs(5, [20], noise=2.0),
         6: blobs(6, [5, 5, 5, 5, 5], noise=0.05), 7: blobs(7, [30, 1], noise=0.3), 8: blobs(8, [3])}


def frame(spark, cases):
    rows = [(t, i, [float(v) for v in row]) for t, x in cases.items() for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "task_id bigint, idx int, embedding array<double>")


def labels_of(df):
    out = {}
    for r in df.orderBy("task_id", "idx").collect():
        out.setdefault(r.task_id, []).append(r.speaker_id)
    return out


def test_speakers_equal_brute_force(spark):
    got = labels_of(V.cluster_speakers(frame(spark, CASES)))
    for t, x in CASES.items():
        assert got[t] == brute_speakers(x).tolist(), t
    assert len(set(got[6])) == 4 and len(set(got[4])) == 2 and len(set(got[5])) == 1


def test_large_recordings_get_the_same_speakers(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE_ROWS", 7)
    original = B.cluster_large
    monkeypatch.setattr(B, "cluster_large", lambda *a: original(*a, block_rows=6))
    cases = {t: CASES[t] for t in (1, 3, 5)}
    got = labels_of(V.cluster_speakers(frame(spark, cases), local_rows=14))
    for t, x in cases.items():
        assert got[t] == brute_speakers(x).tolist(), t


def test_silhouette_equals_brute_force(spark):
    from pyspark.sql import functions as F

    cases = {t: CASES[t] for t in (3, 4, 5)}
    df = frame(spark, cases).withColumn("label", F.pmod("idx", F.lit(3)))
    got = {r.task_id: r.silhouette for r in V.silhouette(df).collect()}
    for t, x in cases.items():
        assert got[t] == pytest.approx(brute_silhouette(x, np.arange(len(x)) % 3))


def test_zero_vectors_stay(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [3.0, 4.0])], "task_id bigint, idx int, embedding array<double>")
    assert [r.embedding for r in V.normalize(df).orderBy("idx").collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_segments_without_embedding_get_speaker_zero(spark):
    segments = spark.createDataFrame([(6, i) for i in range(27)] + [(99, 0)], "task_id bigint, idx int")
    out = {(r.task_id, r.idx): r.speaker_id for r in V.assign_speakers(segments, frame(spark, {6: CASES[6]})).collect()}
    assert out[(6, 26)] == out[(99, 0)] == 0 and len({out[(6, i)] for i in range(25)}) == 4


def ties(seed, n):
    """Vectors with many equal distances: few directions, whole copies, a zero vector."""
    rng = np.random.default_rng(seed)
    rows = rng.integers(-1, 2, (n, 3)).astype(float)
    rows[0], rows[-1] = 0.0, rows[1]
    return rows


def test_ties_fall_alike_on_both_sides_of_the_limit(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE_ROWS", 9)
    original = B.cluster_large
    monkeypatch.setattr(B, "cluster_large", lambda *a: original(*a, block_rows=5))
    cases = {t: ties(t, n) for t, n in enumerate([3, 13, 14, 20])}
    whole = labels_of(V.cluster_speakers(frame(spark, cases), floor=-1.0, margin=0.0))
    assert labels_of(V.cluster_speakers(frame(spark, cases), floor=-1.0, margin=0.0, local_rows=13)) == whole


@pytest.mark.parametrize("seed", range(4))
def test_remembered_neighbours_give_the_tree_of_a_full_search(seed):
    x = np.random.default_rng(seed).normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = V.average_link(x, np.ones(60))
    for k in (2, 3, 7, 20):
        assert V.cut_tree(60, *tree, k).tolist() == brute_tree(x, k).tolist()


def test_rows_without_a_vector_have_no_speaker(spark):
    rows = [(1, 0, None), (1, 1, [1.0, 0.0]), (1, 2, [float("nan"), 0.0]), (1, 3, [1.0, None]), (2, 0, None), (3, 5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "task_id bigint, idx int, embedding array<double>")
    assert labels_of(V.cluster_speakers(df)) == {1: [0], 3: [0]}
    assert V.cluster_speakers(df.limit(0)).collect() == []
