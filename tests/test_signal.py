import math

import numpy as np
import pytest

from voxlake.operators import signal as G


def frame(spark, series):
    rows = [(s, i, float(v)) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id bigint, pos bigint, value double")


def arrays(df, column="value", key="series_id"):
    out = {}
    for r in df.orderBy(key, "pos").collect():
        out.setdefault(r[key], []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


def resample(values, ratio):
    n = int(len(values) * ratio)
    at = np.linspace(0, len(values) - 1, n)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, len(values) - 1)
    return values[low] * (1 - (at - low)) + values[high] * (at - low)


@pytest.mark.parametrize("ratio", [3.0, 2.0, 1.0, 0.4, 48000 / 44100, 16 / 44.1])
def test_resample_equals_interpolation(spark, ratio):
    rng = np.random.default_rng(1)
    series = {i: rng.normal(size=n) for i, n in enumerate([1, 2, 3, 10, 101, 1000])}
    got = arrays(G.resample_linear(frame(spark, series), ratio))
    for i, values in series.items():
        expected = resample(values, ratio)
        assert len(got.get(i, [])) == len(expected)
        if len(expected):
            np.testing.assert_allclose(got[i], expected, atol=1e-9)


def test_gate_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    values = np.where(np.arange(900) // 60 % 3 == 0, rng.normal(size=900), 0.0)
    window, half, reach = 40, 20, 8
    power = np.array([np.mean(values[max(0, i - half) : i + half] ** 2) for i in range(900)])
    gain = np.array([0.3 if (power[max(0, i - reach) : i + reach] > 1e-4).any() else 1.0 for i in range(900)])
    df = frame(spark, {1: values, 2: values[:30]})
    for gated in (G.speech_gate(df, window), G.ducking_gain(G.moving_power(df, window), window)):
        np.testing.assert_allclose(arrays(gated, "power")[1], power, atol=1e-12)
        assert (arrays(gated, "gain")[1] == gain).all()


def test_margins_of_small_blocks(spark):
    from pyspark.sql import functions as F

    from voxlake.plans.grid import framed

    values = np.random.default_rng(3).normal(size=500)
    got = framed(frame(spark, {1: values}), ["series_id"], "pos", 7, 4, size=16, total=lambda w: F.sum("value").over(w))
    np.testing.assert_allclose(arrays(got, "total")[1], [values[max(0, i - 7) : i + 5].sum() for i in range(500)], atol=1e-9)


def _gapped(rng):
    """Bursts with gaps of all widths around the reaches in use; the last one is empty but for one sample."""
    values = np.zeros(700)
    for at, n in ((0, 3), (30, 12), (43, 5), (90, 1), (120, 40), (190, 2), (400, 30), (699, 1)):
        values[at : at + n] = rng.normal(size=n)
    one = np.zeros(50)
    one[49] = 3.0
    return {1: values, 2: one, 3: rng.normal(size=25)}


@pytest.mark.parametrize("size", [None, 32])
@pytest.mark.parametrize("window,threshold", [(40, 1e-4), (40, 0.2), (20, 0.0), (2, 0.05)])
def test_gapped_signals_equal_filled_ones(spark, monkeypatch, size, window, threshold):
    from voxlake.plans import grid

    if size:
        monkeypatch.setattr(G, "with_margin", lambda *a: grid.with_margin(*a, size=size))
    series = _gapped(np.random.default_rng(5))
    total, half, reach = 720, window // 2, window // 5
    df = frame(spark, series).where("value <> 0")
    timeline = spark.createDataFrame([(i, total) for i in series], "series_id bigint, total_samples bigint")
    power = {(r.series_id, r.pos): r.power for r in G.sparse_power(df, window, timeline).collect()}
    gate = {(r.series_id, r.pos): (r.power, r.gain) for r in G.sparse_gate(df, window, threshold, timeline=timeline).collect()}
    all_gains = {(r.series_id, r.pos): r.gain for r in G.sparse_gate(df, window, threshold, timeline=timeline, everywhere=True).collect()}
    assert power.keys() == gate.keys() and len(power) == df.count()
    for i, given in series.items():
        values = np.concatenate([given, np.zeros(total - len(given))])
        mean = np.array([np.mean(values[max(0, p - half) : p + half] ** 2) for p in range(total)])
        low = [bool((mean[max(0, p - reach) : p + reach] > threshold).any()) for p in range(total)]
        for p in range(total):
            assert all_gains.get((i, p), 1.0) == (0.3 if low[p] else 1.0)
            if values[p] != 0:
                assert math.isclose(power[i, p], mean[p], rel_tol=1e-9) and math.isclose(gate[i, p][0], mean[p], rel_tol=1e-9)
                assert gate[i, p][1] == (0.3 if low[p] else 1.0)


@pytest.mark.parametrize("reach", [0, 1, 7, 30])
def test_zeros_near_samples(spark, reach):
    values = _gapped(np.random.default_rng(6))[1]
    got = G.fill_near(frame(spark, {1: values}).where("value <> 0"), reach).orderBy("pos").collect()
    wanted = [p for p in range(700) if (values[max(0, p - reach) : p + reach + 1] != 0).any()]
    assert [r.pos for r in got] == wanted and [r.filled for r in got] == [bool(values[p] == 0) for p in wanted]


def test_no_samples_and_no_timeline(spark):
    none = spark.createDataFrame([], "series_id bigint, pos bigint, value double")
    assert G.sparse_power(none, 20).count() == 0 and G.sparse_gate(none, 20).count() == 0
    with pytest.raises(ValueError):
        G.sparse_gate(none, 20, -1.0)


def test_edge_fade(spark):
    got = arrays(G.edge_fade(frame(spark, {1: np.ones(10), 2: np.ones(7)}), 4))
    np.testing.assert_allclose(got[1], [0, 1 / 3, 2 / 3, 1, 1, 1, 1, 2 / 3, 1 / 3, 0])
    assert (got[2] == 1).all()


def test_overlay_add(spark):
    clips = frame(spark, {1: [1.0] * 4, 2: [2.0] * 2}).withColumnRenamed("series_id", "clip_id")
    places = spark.createDataFrame([(7, 1, 0.5), (7, 2, 1.0)], "task_id bigint, clip_id bigint, start_s double")
    assert arrays(G.overlay_add(clips, places, 4, dense=True), key="task_id")[7].tolist() == [0, 0, 1, 1, 3, 3]
    timeline = spark.createDataFrame([(7, 9), (8, 2)], "task_id bigint, total_samples bigint")
    dense = arrays(G.overlay_add(clips, places, 4, dense=True, timeline=timeline), key="task_id")
    assert dense[7].tolist() == [0, 0, 1, 1, 3, 3, 0, 0, 0] and dense[8].tolist() == [0, 0]


def test_peak_rules(spark):
    df = frame(spark, {1: [0.5, -2.0], 2: [0.05, 0.01], 3: [0.5, 0.2], 4: [0.0, 0.0]})
    got = arrays(G.peak_normalize(df, *G.PEAK_RULES["engine"]))
    np.testing.assert_allclose(got[1], [0.2375, -0.95])
    np.testing.assert_allclose(got[2], [0.5, 0.1])
    np.testing.assert_allclose(got[3], [0.5, 0.2])
    assert got[4].tolist() == [0, 0]
    np.testing.assert_allclose(arrays(G.peak_normalize(df, *G.PEAK_RULES["always"]))[3], [0.95, 0.38])


def test_rms_normalize(spark):
    values = np.array([0.1, -0.2, 0.3])
    gain = 10 ** (-14 / 20) / np.sqrt(np.mean(values**2))
    got = arrays(G.rms_normalize(frame(spark, {1: values, 2: [0.0, 0.0]})))
    np.testing.assert_allclose(got[1], np.tanh(values * gain * 0.8) / 0.8)
    assert got[2].tolist() == [0, 0]


def test_series_quality(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(scale=0.2, size=64)
    broken = noise.copy()
    broken[3] = math.nan
    loud = noise.copy()
    loud[5] = math.inf
    series = {1: noise, 2: np.zeros(64), 3: noise * 100, 4: broken, 5: loud}
    meta = spark.createDataFrame([(i, 16) for i in series], "series_id bigint, sample_rate int")
    rows = {r.series_id: r for r in G.series_quality(frame(spark, series), meta).collect()}
    assert [rows[i].verdict for i in (1, 2, 3, 4, 5)] == ["ok", "near_silent", "clipped", "non_finite", "clipped"]
    assert rows[1].duration == 4.0 and not rows[1].too_short
    assert rows[1].std == pytest.approx(np.std(noise))


def test_mixing(spark):
    speech, back = np.array([0.5] * 7), np.array([0.1, 0.2, 0.3])
    out = arrays(G.mix_with_background(frame(spark, {1: speech}), frame(spark, {1: back}), rate=100))[1]
    looped = np.tile(back, 3)[:7]
    np.testing.assert_allclose(out, speech * 10 ** (-6 / 20) + looped * 10 ** (-20 / 20) * 0.3)
    np.testing.assert_allclose(arrays(G.mix_with_background(frame(spark, {1: speech * 4}), None))[1], [0.99] * 7)
    tracks = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 0.5), (1, 1, 0, 1.0)], "series_id bigint, track_id bigint, pos bigint, value double")
    gains = spark.createDataFrame([(0, 0.0), (1, 0.0)], "track_id bigint, gain_db double")
    np.testing.assert_allclose(arrays(G.mix_tracks(tracks, gains))[1], [0.95, 0.2375])


def test_fit_and_trim(spark):
    clips = spark.createDataFrame([(1, 1.0, 1.04), (2, 1.0, 4.0), (3, 4.0, 1.0), (4, 1.0, 0.0)], "series_id bigint, current_s double, target_s double")
    rows = {r.series_id: r for r in G.fit_plan(clips, 8).collect()}
    assert [rows[i].stretch_rate for i in (1, 2, 3, 4)] == [None, 0.5, 2.0, None]
    assert [rows[i].target_samples for i in (1, 2, 3, 4)] == [8, 32, 8, 0]
    samples = frame(spark, {1: [1.0] * 5, 2: [1.0] * 5})
    lengths = spark.createDataFrame([(1, 3), (2, 8), (3, 2)], "series_id bigint, target_samples bigint")
    got = arrays(G.trim_pad(samples, lengths))
    assert {k: v.tolist() for k, v in got.items()} == {1: [1, 1, 1], 2: [1] * 5 + [0] * 3, 3: [0, 0]}


def test_trim_reference(spark):
    df = frame(spark, {1: range(20), 2: range(40), 3: range(100)})
    got = arrays(G.trim_reference(df, 4))
    assert [len(got[i]) for i in (1, 2, 3)] == [20, 32, 32]
    assert got[3][0] == 20 and got[2][0] == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_statistics_join_with_and_without_broadcast(spark, limit):
    spark.conf.set("spark.voxlake.broadcastRows", str(limit))
    try:
        got = arrays(G.peak_normalize(frame(spark, {i: [i + 1.0, 0.5] for i in range(20)}), *G.PEAK_RULES["mix"]))
    finally:
        spark.conf.unset("spark.voxlake.broadcastRows")
    np.testing.assert_allclose(got[19], [0.95, 0.5 / 20 * 0.95])
