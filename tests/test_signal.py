from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import filters as B
from fathomline.functions import series as S
from fathomline.functions import spectral as X
from fathomline.operators import picks as P
from fathomline.operators import traces as T
from fathomline.plans import noise as N

rng = np.random.default_rng(0)
DATA = rng.normal(size=(6, 200))


@pytest.fixture(scope="module")
def traces(spark):
    rows = [(0, i, [float(v) for v in x]) for i, x in enumerate(DATA)]
    return spark.createDataFrame(rows, "chunk int, channel int, samples array<double>").withColumns({"dt": F.lit(0.01), "fs": F.lit(100.0), "dx": F.lit(2.0), "t0_sec": F.lit(0.0), "begin_us": F.lit(0)}).cache()


def arrays(df, col):
    return np.array([r.y for r in df.select("channel", col.alias("y")).orderBy("channel").collect()])


def test_time_axis_operators_match_numpy(traces):
    x, i = F.col("samples"), np.arange(200)
    fit = np.polynomial.polynomial.polyfit(i, DATA.T, 1)
    assert np.allclose(arrays(traces, S.detrend(x)), DATA - (fit[0][:, None] + fit[1][:, None] * i), atol=1e-9)
    assert np.allclose(arrays(traces, S.gradient(x, F.lit(0.01))), np.gradient(DATA, 0.01, axis=1))
    assert np.allclose(arrays(traces, S.backward_difference(x, F.lit(0.01)))[:, 1:], np.diff(DATA, axis=1) / 0.01)
    y = np.cumsum(DATA, axis=1) * 0.01
    y[:, 0] = 0
    assert np.allclose(arrays(traces, S.integrate(0.01)(x)), y)
    assert np.allclose(arrays(traces, S.peak_scaled(x)), DATA / np.abs(DATA).max(axis=1, keepdims=True))
    for k in (1, 2, 5, 8):
        a = np.pad(np.abs(DATA), ((0, 0), (k // 2, k - 1 - k // 2)), mode="edge")
        env = np.lib.stride_tricks.sliding_window_view(a, k, axis=1).mean(axis=2)
        assert np.allclose(arrays(traces, S.running_abs_mean(k)(x)), DATA / env)
    w = arrays(traces, S.taper(x, 0.5)) / DATA
    assert np.allclose(w, w[:, ::-1]) and np.allclose(w[:, 0], 0, atol=1e-12) and np.allclose(w[:, 60:140], 1)


def test_unwrap_counts():
    true = np.cumsum(rng.integers(-(2**30), 2**30, size=(3, 500)), axis=1).astype(float)
    wrapped = (true + 2**31) % 2**32 - 2**31
    d = np.diff(wrapped, axis=1)
    y = wrapped.copy()
    y[:, 1:] += np.cumsum(np.where(d > 2**31, -(2.0**32), np.where(d < -(2**31), 2.0**32, 0)), axis=1)
    assert np.allclose(np.diff(y, axis=1), np.diff(true, axis=1))


def test_edge_cases(spark):
    df = spark.createDataFrame([(0, [3.0]), (1, []), (2, None), (3, [1.0, 1.0]), (4, [0.0, 0.0, 0.0])], "channel int, samples array<double>")
    x = F.col("samples")
    got = {r.channel: r for r in df.select("channel", S.detrend(x).alias("d"), S.gradient(x, F.lit(1.0)).alias("g"), S.running_abs_mean(2)(x).alias("r"), S.unwrap()(x).alias("u"), S.peak_scaled(x).alias("p"), S.taper(x).alias("t")).collect()}
    assert got[0].d == [0.0] and got[0].g is None and got[0].t == [3.0]
    assert got[1].d == [] and got[1].r == [] and got[2].d is None and got[2].u is None
    assert got[3].g == [0.0, 0.0] and got[4].r == [0.0] * 3 and got[4].p == [0.0] * 3


def test_containers(traces):
    cut = T.truncate(traces, (1, 4), (0.105, 0.2)).orderBy("channel").collect()
    assert [r.channel for r in cut] == [1, 2, 3] and cut[0].nt == 10 and cut[0].t0_sec == pytest.approx(0.1)
    assert np.allclose(cut[0].samples, DATA[1, 10:20])
    assert T.truncate(traces, None, (-5.0, -1.0)).select(F.max(F.size("samples"))).first()[0] == 0  # wholly before the data
    assert [r.channel for r in T.select_channels(traces, [4, 1, 1]).orderBy("position").collect()] == [4, 1, 1]
    assert T.select_channels(traces, []).count() == 0
    half = T.skip_samples(traces, 2).first()
    assert half.nt == 100 and half.dt == pytest.approx(0.02)
    assert T.skip_channels(traces, 3).count() == 2
    back = T.to_traces(T.to_samples(traces, ["chunk", "channel"]), ["chunk", "channel"])
    assert np.allclose(arrays(back, F.col("samples")), DATA)
    for block in (7, 64, 2048):
        mode = T.subtract_common_mode(traces, "chunk", 1, 4, block=block)
        assert np.allclose(arrays(T.joined_blocks(mode, ["chunk", "channel"]), F.col("samples")), DATA - np.median(DATA[1:4], axis=0))
        assert T.block_samples(mode, ["channel"], block).filter("channel = 2").agg(F.max("it")).first()[0] == 199
    head = T.header(traces, ["chunk", "fs"]).first()
    assert (head.nx, head.n_samples) == (6, 200)


def test_blocks_are_stitched_with_zeros(spark):
    df = spark.createDataFrame([("c", 0, [1.0, 2.0]), ("c", 50_000, [3.0]), ("c", 60_000, [4.0])], "ch string, b long, samples array<double>").withColumn("fs", F.lit(100.0))
    got = {r.it: r.x for r in T.stitched(df, ["ch"], "b", "fs").collect()}
    assert [got[i] for i in range(len(got))] == [1, 2, 0, 0, 0, 3, 4]
    assert T.stitched(df, ["ch"], "b", "fs", fill=False).count() == 4


@pytest.mark.parametrize("order", [1, 2, 3, 4, 7, 14])
@pytest.mark.parametrize("high_pass", [False, True])
def test_corner_gain_of_every_order(order, high_pass):
    f = 0.1
    impulse = np.zeros((1, 4096))
    impulse[0, 0] = 1
    y = B.cascade(impulse, B.sections(f, order, high_pass))[0]
    h = np.abs(np.fft.rfft(y))
    assert abs(np.sum(y * np.exp(-2j * np.pi * f * np.arange(4096)))) == pytest.approx(0.70710678, abs=1e-6)
    assert (h[-1] if high_pass else h[0]) == pytest.approx(1, abs=1e-6)


def test_zero_phase_band_pass(traces):
    t = np.arange(2048) / 100
    x = np.sin(2 * np.pi * 5 * t) + 0.5 * np.sin(2 * np.pi * 30 * t)
    y = B.filtered(x[None, :], 0.02, 0.1, 4, True)[0]
    inner = slice(400, -400)
    assert np.corrcoef(y[inner], np.sin(2 * np.pi * 5 * t)[inner])[0, 1] > 0.999
    assert np.abs(np.fft.rfft(y[inner]))[round(30 * len(y[inner]) / 100)] < 1
    with pytest.raises(ValueError):
        B.bandpass(0.0, 60.0, 0.01)
    out = arrays(traces, B.downsample(5, 0.01)(F.col("samples")))
    assert out.shape == (6, 40)
    assert np.allclose(arrays(traces, B.downsample(5, 0.01, anti_alias=False)(F.col("samples"))), DATA[:, ::5])


def direct(a, b, lag):
    return np.array([sum(a[t] * b[t + L] for t in range(len(a)) if 0 <= t + L < len(b)) for L in range(-lag, lag + 1)])


def test_correlation_is_the_direct_sum_and_finds_the_shift():
    a, b = rng.normal(size=64), rng.normal(size=64)
    for lag in (0, 1, 20, 63):
        assert np.allclose(X.correlate(a[None], b[None], lag)[0], direct(a, b, lag))
    x = rng.normal(size=512)
    for opts in ({}, {"whitening": True}, {"whitening": 2.0, "fs": 100.0}, {"whitening": True, "fs": 100.0, "band": (5.0, 45.0)}):
        assert np.argmax(X.correlate(x[None], np.roll(x, 7)[None], 50, **opts)[0]) - 50 == 7
    with pytest.raises(ValueError):
        X.correlate(a[None], b[None], 64)
    with pytest.raises(ValueError):
        X.correlate(a[None], b[None], 3, whitening=2.0)


def test_whitening_flattens():
    spec = np.fft.rfft(rng.normal(size=(2, 256)), axis=1)
    assert np.allclose(np.abs(X.whiten(spec)), 1)
    out = np.abs(X.whiten(spec, band=(10.0, 30.0), df=0.5))
    assert out[:, 0] == pytest.approx(0, abs=1e-9) and out[:, 40] == pytest.approx(1)
    k, n, mag = 5, spec.shape[1], np.abs(spec)
    env = np.array([[mag[r, max(0, i - k // 2) : i - k // 2 + k].mean() for i in range(n)] for r in range(2)])
    assert np.allclose(X.whiten(spec, k), spec / np.maximum(env, 1e-3 * mag.mean(axis=1, keepdims=True)))


def test_stack_over_segments_and_chunks(spark):
    a = rng.normal(size=337)
    df = spark.createDataFrame([(0, 0, [float(v) for v in a]), (0, 1, [float(v) for v in np.roll(a, 5)]), (1, 0, [float(v) for v in a[:220]]), (1, 1, [float(v) for v in np.roll(a, 5)[:220]])], "chunk int, channel int, samples array<double>")
    pairs = spark.createDataFrame([(0, 1)], "ch1 int, ch2 int")
    stacks = N.stack(N.pair_traces(df, pairs, "chunk"), ["chunk"], 100, 20)
    got = {r.chunk: (r.nseg, int(np.argmax(r.cc)) - 20) for r in stacks.collect()}
    assert got == {0: (3, 5), 1: (2, 5)}
    whole = N.dataset_stack(stacks).first()
    by = {r.chunk: np.array(r.cc) for r in stacks.collect()}
    assert whole.nseg == 5 and np.allclose(whole.cc, (3 * by[0] + 2 * by[1]) / 5)
    assert N.stack(N.pair_traces(df, pairs, "chunk"), ["chunk"], 1000, 20).count() == 0


def test_preparation_chain(traces):
    out = N.prepare(traces, ["chunk", "channel"], "chunk", 0.01, band=(2.0, 20.0), step=5, window_sec=0.5)
    got = arrays(out, F.col("samples"))
    assert got.shape == (6, 40) and np.isfinite(got).all()
    bits = arrays(N.prepare(traces, ["chunk", "channel"], "chunk", 0.01, common_mode=False), F.col("samples"))
    assert set(np.unique(bits)) <= {-1.0, 0.0, 1.0}


def test_picks(spark):
    df = spark.createDataFrame([(0, [0.1, 0.9, 0.9, 0.2, 0.5]), (1, [0.1]), (2, [0.7]), (3, None), (4, [])], "channel int, s array<double>")
    got = P.pick(df, "channel", {"P": F.col("s"), "S": F.transform("s", lambda v: 1 - v)}, 0.45, F.lit(100.0), F.lit(1_000_000))
    rows = sorted((r.channel_index, r.phase_type, r.phase_index, r.phase_time_us) for r in got.collect())
    assert rows == [(0, "P", 1, 1_010_000), (0, "P", 4, 1_040_000), (0, "S", 0, 1_000_000), (0, "S", 3, 1_030_000), (1, "S", 0, 1_000_000), (2, "P", 0, 1_000_000)]
    assert {r.phase_type: r.n for r in P.pick_counts(got).collect()} == {"P": 3, "S": 3}
