import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import intervals as I


def split(start, end):
    if end - start <= 30:
        return [(start, end)]
    out, at = [], start
    while at < end:
        stop = min(at + 25, end)
        if end - stop < 5:
            stop = end
        out.append((at, stop))
        at = stop
    return out


def blocks(rows, budget):
    out, open_block, total = [], [], 0.0
    for start, end in sorted(rows):
        length = end - start
        if open_block and total + length > budget:
            out.append((open_block[0][0], open_block[-1][1], len(open_block)))
            open_block, total = [], 0.0
        open_block.append((start, end))
        total = total + length
    return out + [(open_block[0][0], open_block[-1][1], len(open_block))]


def test_split_long_equals_a_loop(spark):
    lengths = [0.0, 29.9, 30.0, 30.01, 49.9, 50.0, 54.9, 55.0, 55.1, 80.0, 1000.3] + [random.Random(2).uniform(0, 300) for _ in range(100)]
    df = spark.createDataFrame([(i, 1.0, 1.0 + d) for i, d in enumerate(lengths)], "series_id bigint, start_s double, end_s double")
    got = {}
    for r in I.split_long(df).orderBy("series_id", "piece_no").collect():
        got.setdefault(r.series_id, []).append((r.start_s, r.end_s))
    for i, d in enumerate(lengths):
        expected = split(1.0, 1.0 + d)
        assert len(got[i]) == len(expected)
        assert all(a == pytest.approx(b) for a, b in zip(got[i], expected))


def series(seed, count, step=0.1):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for _ in range(count):
        at += rng.choice([0.0, 0.5, 2.0])
        length = rng.choice([0.0, step, 3.0, 7.5, 10.0, 15.0, 29.9, 31.0, 45.0])
        rows.append((at, at + length))
        at += length
    return rows


@pytest.mark.parametrize("rows_per_chunk", [0, 4, 25])
def test_pack_blocks_equals_a_loop(spark, chunked, rows_per_chunk):
    data = {s: series(s, n) for s, n in enumerate([1, 2, 40, 300, 300, 7])}
    data[9] = [(float(i), float(i)) for i in range(50)]  # nothing to add up
    flat = [(s, a, b) for s, rows in data.items() for a, b in rows]
    random.Random(3).shuffle(flat)
    df = spark.createDataFrame(flat, "series_id bigint, start_s double, end_s double")
    with chunked(rows_per_chunk):
        out = I.pack_blocks(df, 30.0).orderBy("series_id", "block_no").collect()
    got = {}
    for r in out:
        got.setdefault(r.series_id, []).append((r.block_no, r.start_s, r.end_s, r.intervals))
    for s, rows in data.items():
        assert got[s] == [(i, *b) for i, b in enumerate(blocks(rows, 30.0))]


@pytest.mark.parametrize("rows_per_chunk", [0, 900])
def test_pack_blocks_over_many_batches(spark, chunked, rows_per_chunk):
    """Series longer than an Arrow batch; whole numbers, where a total may equal the budget; lengths that rounding moves."""
    rng = random.Random(4)
    data = {1: [(float(i), float(i + rng.choice([1, 2, 10]))) for i in range(23_000)], 2: [(i / 10, i / 10 + 0.1) for i in range(12_000)], 3: [(i * 1.0, i + rng.random() * 9) for i in range(9_000)]}
    df = spark.createDataFrame([(s, a, b) for s, rows in data.items() for a, b in rows], "series_id bigint, start_s double, end_s double")
    with chunked(rows_per_chunk):
        out = I.pack_blocks(df, 30.0).orderBy("series_id", "block_no").collect()
    for s, rows in data.items():
        assert [(r.start_s, r.end_s, r.intervals) for r in out if r.series_id == s] == blocks(rows, 30.0)


@pytest.mark.parametrize("seed", range(5))
def test_successors_equal_a_loop(seed):
    rng = random.Random(seed)
    d = np.array([rng.choice([0.0, 0.1, 0.2, 1.0, 7.3, 31.0] + [-1.0] * (seed == 4)) for _ in range(400)])
    ends = np.array([150] * 150 + [400] * 250)
    got = I.successors(d, ends, 30.0)
    for i in range(400):
        total, j = d[i], i + 1
        while j < ends[i] and not total + d[j] > 30.0:
            total, j = total + d[j], j + 1
        assert got[i] == j


def test_missing_lengths_count_as_none(spark):
    df = spark.createDataFrame([(1, 0.0, 20.0), (1, 1.0, None), (1, 2.0, 12.0), (1, 3.0, 13.0), (None, 0.0, 5.0), (None, 1.0, 40.0)], "series_id bigint, start_s double, end_s double")
    got = sorted((r.series_id or 0, r.block_no, r.start_s, r.intervals) for r in I.pack_blocks(df, 30.0).collect())
    assert got == [(0, 0, 0.0, 1), (0, 1, 1.0, 1), (1, 0, 0.0, 3), (1, 1, 3.0, 1)]


@pytest.mark.parametrize("rows_per_chunk", [0, 3])
def test_speech_segments(spark, chunked, rows_per_chunk):
    frames = [(1, t / 10, 0.9) for t in range(5, 20)] + [(1, t / 10, 0.9) for t in range(25, 40)]  # 0.6 s of silence is bridged
    frames += [(1, 10.0, 0.15), (1, 10.2, 0.5), (1, 20.0, 0.9), (1, 30.0, 0.1)]  # at the threshold; one lone frame; below it
    frames += [(2, 1.0, 0.05)]
    frames += [(4, t / 2, 1.0) for t in range(0, 121)]
    meta = [(1, 40.0), (2, 12.5), (3, 0.0), (4, 60.0)]
    with chunked(rows_per_chunk):
        out = I.speech_segments(
            spark.createDataFrame(frames, "series_id bigint, t double, prob double"),
            spark.createDataFrame(meta, "series_id bigint, duration double"),
        ).orderBy("series_id", "start_s").collect()
    got = [(r.series_id, round(r.start_s, 6), round(r.end_s, 6)) for r in out]
    assert got == [(1, 0.2, 4.2), (1, 9.7, 10.5), (2, 0.0, 12.5), (4, 0.0, 25.0), (4, 25.0, 50.0), (4, 50.0, 60.3)]


def test_sliding_chunks_equals_a_loop(spark):
    lengths = [0.0, 1.0, 30.0, 30.5, 59.0, 59.1, 88.0, 301.7]
    df = spark.createDataFrame(list(enumerate(lengths)), "series_id bigint, duration double")
    got = {}
    for r in I.sliding_chunks(df).orderBy("series_id", "chunk_no").collect():
        got.setdefault(r.series_id, []).append((r.start_s, r.end_s))
    for i, duration in enumerate(lengths):
        expected, start = [], 0.0
        while start < duration:
            end = min(start + 30, duration)
            expected.append((start, end))
            if end >= duration:
                break
            start = end - 1
        assert all(a == pytest.approx(b) for a, b in zip(got.get(i, []), expected))
        assert len(got.get(i, [])) == len(expected)


def test_slice_samples_equals_a_theta_join(spark):
    samples = spark.range(0, 200000, 37).select(F.lit(1).cast("bigint").alias("series_id"), F.col("id").alias("pos"), F.lit(1.0).alias("value"))
    bounds = [(1, -1.0, 2.0), (1, 4.0, 4.0), (1, 4.0, 12.5), (1, 0.0, 100.0)]
    intervals = spark.createDataFrame([(s, a, b, i) for i, (s, a, b) in enumerate(bounds)], "series_id bigint, start_s double, end_s double, n int")
    got = {r.n: r["count"] for r in I.slice_samples(samples, intervals, 16000).groupBy("n").count().collect()}
    positions = range(0, 200000, 37)
    expected = {i: sum(max(0, int(a * 16000)) <= p < int(b * 16000) for p in positions) for i, (_, a, b) in enumerate(bounds)}
    assert got == {i: n for i, n in expected.items() if n}
    assert I.slice_samples(samples, intervals, 16000, min_samples=1600).select("n").distinct().count() == 3


def test_range_join_of_intervals_of_all_lengths(spark):
    """Against a theta join; what is compared stays near what is found."""
    from voxlake.plans import grid

    rng = random.Random(5)
    intervals = []
    for i in range(300):
        low = rng.randrange(-50, 200_000)
        intervals.append((1 + i % 2, low, low + rng.choice([0, 1, 63, 64, 65, 300, 5_000, 70_000, -5]), i))
    points = [(s, p) for s in (1, 2, 3) for p in sorted(rng.sample(range(200_000), 2_000))]
    left = spark.createDataFrame(points, "s int, pos bigint")
    right = spark.createDataFrame(intervals, "s int, low bigint, high bigint, n int")
    got = sorted((r.s, r.pos, r.n) for r in grid.range_join(left, right, ["s"], "pos", "low", "high").collect())
    assert got == sorted((s, p, n) for s, p in points for t, a, b, n in intervals if s == t and a <= p < b)
    size = F.lit(64) * F.pow(F.lit(2.0), grid.length_class(F.col("high") - F.col("low")) * 2)
    cells = right.where("high > low").select((F.floor((F.col("high") - 1) / size) - F.floor(F.col("low") / size) + 1).alias("cells"), (size / (F.col("high") - F.col("low"))).alias("share"), "high", "low")
    assert cells.agg(F.max("cells")).first()[0] <= 2 and cells.where("high - low > 64").agg(F.max("share")).first()[0] < 4
    assert grid.range_join(left, right.limit(0), ["s"], "pos", "low", "high").collect() == []
