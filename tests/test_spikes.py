from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fathomline.functions import charts as C
from fathomline.operators.spikes import implausible_positions, off_scale


def noise(n, seed, scale=1.0):
    return np.random.default_rng(seed).normal(0, scale, n)


def found(x):
    return sorted(np.nonzero(C.implausible(np.asarray(x, float)[None, :])[0])[0].tolist())


def test_planted_spikes_are_found_at_any_loudness():
    for scale in (1e-9, 1.0, 1e5):
        for seed in range(20):
            x = noise(160, seed, scale)
            x[40] += 40 * scale
            x[80:82] -= np.array([60, 45]) * scale
            x[120:123] += np.array([40, 33, 27]) * scale
            assert found(x) == [40, 80, 81, 120, 121, 122]


def test_drift_offsets_and_arrivals_are_no_spikes():
    for seed in range(20):
        t = np.arange(200)
        assert found(noise(200, seed) + 0.5 * t) == []
        assert found(noise(200, seed) + 60 * (t >= 90)) == []
        assert found(noise(200, seed) + 25 * np.exp(-(((t - 100) / 25) ** 2)) * np.sin(t / 2)) == []


def test_impossible_and_stuck_values():
    x = noise(64, 3)
    x[5], x[6], x[7] = np.nan, np.inf, -1e12
    x[20:30] = x[20]
    x[40:49] = x[40]
    assert found(x) == [5, 6, 7, *range(20, 30)]
    assert found(np.zeros(12)) == list(range(12)) and found([1.0]) == [] and found([1.0, 2.0]) == []


def test_long_series_are_cut_without_a_seam():
    x = noise(20_000, 9)
    at = [100, C.PIECE - 1, C.PIECE, 2 * C.PIECE + 3, 19_000]
    x[at[0]] += 50
    x[at[1]], x[at[2]] = 60, 55
    x[at[3]] -= 70
    x[at[4]] += 40
    assert found(x) == at


def test_pieces_give_the_chart_of_the_whole_row(monkeypatch):
    rng = np.random.default_rng(4)
    for kind in range(6):
        x = rng.normal(0, 1, (3, 3000)) + (kind == 1) * np.cumsum(rng.normal(0, 1, (3, 3000)), axis=1) + (kind == 2) * 40 * np.sin(np.arange(3000) / 50)
        if kind > 2:
            x[:, rng.integers(0, 3000, 60)] += rng.choice([-1, 1], 60) * 60
        if kind > 3:
            x[:, 900:1400] = np.nan
            x[1, rng.integers(0, 3000, 900)] = np.nan
        if kind == 5:
            x[:, 1000:] *= np.exp(np.arange(2000) / 300)  # the scale grows, so that a run-up does not tell it
        s = C.scatter(x)
        whole = C.chart(x, s)
        for piece, up in ((256, 64), (256, 4), (1000, 512)):
            monkeypatch.setattr(C, "PIECE", piece)
            monkeypatch.setattr(C, "RUN_UP", up)
            assert (C.chart(x, s) == whole).all(), (kind, piece)
        monkeypatch.undo()


def test_column_of_arrays(spark):
    x = noise(50, 1)
    x[10] = 99
    rows = [(1, [float(v) for v in x]), (2, None), (3, []), (4, [1.0, None, float("nan")]), (5, [float(v) for v in x])]
    df = spark.createDataFrame(rows, "id int, samples array<float>").withColumn("pos", F.lit("clash"))
    out = {r.id: r.p for r in df.select("id", implausible_positions(F.col("samples")).alias("p")).collect()}
    assert out == {1: [10], 2: [], 3: [], 4: [2], 5: [10]}
    assert df.limit(0).select(implausible_positions(F.col("samples"))).count() == 0


def test_grades_off_their_groups_scale(spark):
    rows = [(i, "flags", i % 2) for i in range(20)] + [(100, "flags", 50), (101, "flags", -1), (102, "flags", None)]
    rows += [(200 + i, "score", 5 * i) for i in range(21)] + [(300, "score", 101), (301, "score", -128), (302, "score", 1)] + [(400, None, 3), (401, None, 120)]
    df = spark.createDataFrame(rows, "id int, g string, grade int").withColumns({"_group": F.lit(1), "_top": F.lit(0)})
    assert sorted(r.id for r in off_scale(df, "g", "grade").collect()) == [100, 101, 300, 301, 401]
    assert off_scale(df.limit(0), "g", "grade").count() == 0
