from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import catalog as C
from fathomline.operators import joins as J
from fathomline.operators.ordered import sharded_lag, sharded_runs
from fathomline.plans import desample as D
from fathomline.plans import events as E

SCHEMA = "key string, file string, begin_us long, end_us long, fs double, nt long, nx int, first_sample long"


def row(file, begin_s, n=100, fs=100.0, nx=4, first=0, key="k"):
    b = round(begin_s * 1e6)
    return (key, file, b, b + round((n - 1) * 1e6 / fs), fs, n, nx, first)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def segment_ids(spark, rows):
    return {r.file: r.segment_id for r in C.segments(frame(spark, rows), "key").collect()}


def test_breaks_of_segments(spark):
    assert segment_ids(spark, [row("a", 0), row("b", 1.0), row("c", 2.015), row("d", 3.05)]) == {"a": 0, "b": 0, "c": 0, "d": 1}  # the last step is 4.5 spacings
    assert segment_ids(spark, [row("a", 0), row("b", 1.015)]) == {"a": 0, "b": 0}  # 2.5 spacings, the limit itself
    assert segment_ids(spark, [row("a", 0), row("b", 0.985)]) == {"a": 0, "b": 0}  # a slight overlap
    assert segment_ids(spark, [row("a", 0), row("b", 0.97)]) == {"a": 0, "b": 1}
    assert segment_ids(spark, [row("a", 0), row("b", 1.0, fs=50.0), row("c", 3.0, fs=50.0, nx=5)]) == {"a": 0, "b": 1, "c": 2}
    assert segment_ids(spark, [row("a", 0), ("k", "b", 1_000_000, 1_990_000, None, 100, 4, 0), ("k", "c", 2_000_000, 2_990_000, float("nan"), 100, 4, 0)]) == {"a": 0, "b": 1, "c": 2}
    rows = C.segments(frame(spark, [row("a", 0), row("a", 1.0, first=100)]), "key").collect()
    assert [r.segment_id for r in sorted(rows, key=lambda r: r.begin_us)] == [0, 1]  # the same file twice
    assert C.segments(frame(spark, []), "key").count() == 0


def test_windows_with_padding_and_read_plan(spark):
    rows = C.segments(frame(spark, [row(f, i) for i, f in enumerate("abcde")] + [row("f", 10)]), "key")
    windows = spark.createDataFrame([("k", 1_990_000, 3_500_000)], "key string, window_begin long, window_end long")
    roles = {r.file: r.role for r in C.select_window(rows, windows, "key").collect()}
    assert roles == {"b": "before", "c": "target", "d": "target", "e": "after"}  # b's last sample is at the begin, so it isn't hit
    assert {r.file for r in C.select_window(rows, windows, "key", pad=False).collect()} == {"c", "d"}
    windows = spark.createDataFrame([("k", 3_500_000, 10_200_000)], "key string, window_begin long, window_end long")
    plan = {r.file: (r.sample_from, r.n_samples, r.zeros_before) for r in C.read_plan(rows, windows, "key").collect()}
    assert plan == {"d": (50, 50, 0), "e": (0, 100, 0), "f": (0, 20, 500)}


def test_append_keeps_the_last_of_each_key(spark):
    old = frame(spark, [row("a", 0), row("b", 1), row("b", 2, first=100)])
    new = frame(spark, [row("b", 1, n=50), row("c", 5)])
    got = {(r.file, r.first_sample): r.nt for r in C.append(old, new, ["file", "first_sample"], ["begin_us"]).collect()}
    assert got == {("a", 0): 100, ("b", 0): 50, ("b", 100): 100, ("c", 0): 100}
    assert [r.file for r in C.unknown_files(new, old).collect()] == ["c"]
    done = spark.createDataFrame([("k", 1_000_000)], "key string, until long")
    assert {r.file for r in C.after_cutoff(new, done, "key", F.col("until")).collect()} == {"c"}


def chain(begins, length):
    out, b, begins = [], begins[0], sorted(begins)
    while len(begins) > 1 and b + length <= begins[-1]:
        out.append(b)
        later = [x for x in begins if x >= b + length]
        if not later:
            break
        b = later[0]
    return out


def test_window_chain_is_the_greedy_walk(spark):
    rng = random.Random(3)
    rows = [row(f"f{i}", i) for i in range(50)] + [row(f"g{i}", 200 + i * 1.005) for i in range(40)] + [row("alone", 500)]
    rng.shuffle(rows)
    seg = C.segments(frame(spark, rows), "key")
    expected = []
    for ids in {r.segment_id for r in seg.collect()}:
        b = [r.begin_us for r in seg.collect() if r.segment_id == ids]
        expected += chain(sorted(b), 7_500_000)
    got = sorted(r.window_begin for r in C.window_chain(seg, "key", 7_500_000).collect())
    assert got == sorted(expected) and len(got) > 5
    with pytest.raises(ValueError):
        C.window_chain(seg, "key", 0)


def test_runs_of_stamps(spark):
    df = spark.createDataFrame([("f", i, s, 100.0) for i, s in enumerate([0, 10_000, 20_001, 50_000, 60_000])], "file string, i int, us long, fs double")
    got = sorted((r.run_no, r.first_position, r.n_stamps) for r in C.stamp_runs(df, ["file"], "us", "fs", "i").collect())
    assert got == [(0, 0, 3), (1, 3, 2)]


def test_sharded_lag_and_runs(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None, "b"]), t, rng.randint(0, 2)) for t in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    lagged = sharded_lag(df, ["k"], F.floor(F.col("t") / 7), ["t"], ["v"])
    for size in (3, 50, 5000):
        got = {(r.k, r.t): (r.prev.v if r.prev else None, r.run) for r in sharded_runs(lagged, ["k"], F.floor(F.col("t") / size), ["t"], ["v"], lambda now, was: now["v"] != was["v"], "run").collect()}
        for k in ("a", "b", None):
            before, run = None, 0
            for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
                run += before is not None and v != before
                assert got[k, t] == (before, run)
                before = v


def test_asof_join_finds_the_latest_row_at_or_before(spark):
    rng = random.Random(11)
    left = [(rng.choice(["a", "b", None]), rng.randint(0, 500), i) for i in range(150)]
    right = [(rng.choice(["a", "b", "c"]), rng.randint(0, 500), rng.randint(0, 99)) for _ in range(40)]
    a, b = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, at long, v long")
    for shard in (7, 90, 10_000):
        got = {r.i: r.v for r in J.asof_join(a, b, ["k"], "t", "at", ["v"], shard).collect()}
        assert len(got) == 150
        for k, t, i in left:
            before = [(at, v) for k2, at, v in right if k2 == k and at <= t]
            assert got[i] == (max(before)[1] if before else None), (shard, k, t)
    assert J.asof_join(a, b.limit(0), ["k"], "t", "at", ["v"]).filter("v is not null").count() == 0


def test_interval_join_gives_each_pair_once(spark):
    rng = random.Random(8)
    a = [(i, b, b + rng.choice([0, 5, 300])) for i in range(60) for b in [rng.randint(0, 2000)]]
    b = [(i, s, s + rng.choice([1, 50])) for i in range(60) for s in [rng.randint(0, 2000)]]
    left, right = spark.createDataFrame(a, "i int, lb long, le long"), spark.createDataFrame(b, "j int, rb long, re long")
    got = sorted((r.i, r.j) for r in J.interval_join(left, right, ("lb", "le"), ("rb", "re"), 40).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and x[2] > y[1])


def test_pairs_of_channels(spark):
    df = spark.createDataFrame([("r", i, 0.01 * i, 0.0) for i in range(10)] + [("r", 99, None, 0.0)], "run string, ch int, lat double, lon double")
    km = 0.01 * 111.195
    got = sorted((r.ch1, r.ch2) for r in J.common_offset_pairs(df, "run", "ch", "lat", "lon", 2 * km, km / 2).collect())
    assert got == [(i, i + 2) for i in range(8)]
    assert len(J.common_offset_pairs(df, "run", "ch", "lat", "lon", 2 * km).collect()) == 9
    d = df.limit(1).select(J.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0]
    assert d == pytest.approx(111.195, abs=1e-3)


def test_events_and_their_status(spark):
    catalog = frame(spark, [row("a", 0, n=1000), row("b", 10, n=1000)])
    events = spark.createDataFrame([("x", 9_000_000), ("y", 500_000_000), ("z", 12_000_000)], "event_id string, event_us long")
    plan = E.extract_plan(events, catalog, 2_000_000, 3_000_000, bucket_us=1_000_000)
    got = {(r.event_id, r.file): (r.offset, r.n_samples, r.event_index) for r in plan.collect()}
    assert got == {("x", "a"): (700, 300, 200), ("x", "b"): (0, 200, -100), ("z", "b"): (0, 500, 200)}
    done = spark.createDataFrame([("z",)], "event_id string")
    status = {r.status: r.n for r in E.status_counts(E.extract_status(events, plan, done)).collect()}
    assert status == {"extract": 1, "fail": 1, "skip": 1}


def test_desample_trim_and_pending(spark):
    df = spark.range(1).select(*[c.alias(n) for n, c in zip(("l", "r"), D.trim_bounds(F.lit(100), F.lit(0), F.lit(100_000), F.lit(1_050_000), F.lit(8_000_000)), strict=True)], *[c.alias(n) for n, c in zip(("l0", "r0"), D.trim_bounds(F.lit(100), F.lit(0), F.lit(100_000), F.lit(None).cast("long"), F.lit(None).cast("long")), strict=True)])
    assert tuple(df.first()) == (10, 80, 0, 100)  # a tie goes to the earlier sample
    windows = spark.createDataFrame([(1_700_000_000_000_000, 1), (1_700_000_060_000_000, 1)], "window_begin long, n int")
    done = spark.createDataFrame([("ProcX-2023-11-14T221320Z.h5",)], "file string")
    assert [r.file for r in D.pending(windows, done, F.lit("X")).collect()] == ["ProcX-2023-11-14T221420Z.h5"]
    assert D.ratio_for(100, 0.4) == 100 and D.ratio_for(100, 0) == 1


def test_desampled_windows_join_without_seams(spark):
    import numpy as np

    fs, n = 100.0, 400
    t = np.arange(6 * n) / fs
    x = np.sin(2 * np.pi * 0.5 * t)
    rows = [("k", f"f{i}", round(i * n / fs * 1e6), round((i * n + n - 1) / fs * 1e6), fs, n, 1, 0, 0, [float(v) for v in x[i * n : (i + 1) * n]]) for i in range(6)]
    df = C.segments(spark.createDataFrame(rows, SCHEMA + ", channel int, samples array<double>"), "key")
    windows = C.window_chain(df, "key", 4_000_000)
    assert windows.count() == 5
    out = D.desample_windows(df, windows, "key", fs, f_max=4.0, order=8).orderBy("window_begin").collect()
    assert [len(r.samples) for r in out] == [40] * 5 and all(r.fs_out == 10.0 for r in out)
    assert [r.begin_us for r in out] == [r.window_begin for r in out]
    y = np.concatenate([r.samples for r in out])
    assert np.abs(y - x[: 5 * n : 10])[5:].max() < 0.02


def test_model_scores_become_picks(spark):
    import numpy as np

    from fathomline.operators import picks as P

    df = spark.createDataFrame([("c", ch, [0.0, 0.1 * ch, 1.0, 0.0]) for ch in range(3)] + [("d", 0, None)], "chunk string, channel int, samples array<double>")
    out = P.scored(df, "channel", "samples", ["chunk"], lambda m: np.stack([m, 1 - m]))
    assert out.count() == 3
    picks = P.pick(out, "channel", {"P": F.col("P")}, 0.5, F.lit(100.0), F.lit(0), ["chunk"])
    assert sorted((r.chunk, r.channel_index, r.phase_index) for r in picks.collect()) == [("c", i, 2) for i in range(3)]
