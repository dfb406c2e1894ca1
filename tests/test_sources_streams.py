from __future__ import annotations

import gzip

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fathomline import __main__ as jobs
from fathomline.operators import catalog as C
from fathomline.plans import noise as N
from fathomline.plans import recordings as R
from fathomline.sources import hdf5, segy, tables
from fathomline.streaming import incremental as I

from . import stubs as H

cloudpickle.register_pickle_by_value(H)

DATA = np.random.default_rng(1).normal(size=(4, 80)).astype(np.float32)


def test_segy_round_trip_through_spark(spark, tmp_path):
    raw = segy.encode_file(DATA, 4000, (2023, 318, 22, 13, 20))
    (tmp_path / "a.segy").write_bytes(raw)
    (tmp_path / "b.segy.gz").write_bytes(gzip.compress(raw))
    rows = segy.read_segy(spark, str(tmp_path), units="count", dx=2.0).orderBy("file", "channel").collect()
    assert len(rows) == 8 and rows[0].fs == 250.0 and rows[0].begin_us == 1_700_000_000_000_000 and rows[0].units == "count"
    assert np.array_equal(np.array([r.samples for r in rows[:4]], np.float32), DATA)
    cat = segy.segy_catalog(segy.read_segy(spark, str(tmp_path))).orderBy("file").collect()
    assert cat[0].nt == 80 and cat[0].end_us - cat[0].begin_us == 79 * 4000


def test_segy_without_headers_and_other_formats():
    raw = segy.encode_file(DATA * 1e4, 0, endian="<")
    bare = raw[:3200] + bytes(400) + raw[3600:]
    got = segy.decode_file(bare, n_traces=4, sample_interval=1 / 250)
    assert np.allclose(got["data"], DATA * 1e4, rtol=1e-6) and got["begin_us"] is None
    assert np.allclose(segy.decode_file(bare, n_samples=80, sample_interval=0.004, conversion_factor=2.0)["data"], DATA * 2e4, rtol=1e-6)
    for wrong in ({}, {"n_traces": 3, "sample_interval": 1}, {"n_samples": 81, "sample_interval": 1}, {"n_traces": 4}):
        with pytest.raises(ValueError):
            segy.decode_file(bare, **wrong)
    for fmt, kind in ((2, ">i4"), (3, ">i2"), (8, "i1")):
        x = np.arange(-8, 8).astype(kind)
        head = bytearray(3600)
        head[3216:3218], head[3220:3222], head[3224:3226] = (np.array([v], ">i2").tobytes() for v in (1000, 16, fmt))
        assert np.array_equal(segy.decode_file(bytes(head) + bytes(240) + x.tobytes())["data"][0], np.arange(-8, 8))
    words = np.array([0x42640000, 0xC276A000], ">u4")
    assert np.allclose(segy.decode(words.tobytes(), 1, ">"), [100.0, -118.625])


def test_processed_and_event_tables(spark, tmp_path):
    df = spark.createDataFrame([("c", 0, [1.0, 2.0], 1_700_000_000_000_000, "OptaSense", "strain/s"), ("c", 1, [3.0, 4.0], 1_700_100_000_000_000, "Other", "strain")], "chunk string, channel int, samples array<double>, begin_us long, origin string, units string")
    tables.write_processed(df, str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("day=*"))) == 2
    got = {r.channel: (r.samples, r.units) for r in tables.read_processed(spark, str(tmp_path / "p"), factor=F.lit(0.5)).collect()}
    assert got == {0: ([5e5, 1e6], "microstrain/s"), 1: ([3e6, 4e6], "microstrain")}
    assert tables.read_processed(spark, str(tmp_path / "p"), convert=False).count() == 2
    ev = spark.createDataFrame([("e", 100, 0, 0.01, 2, [1.0, 2.0, 3.0], 0, "kept")], "event_id string, event_us long, begin_us long, dt double, event_time_index int, samples array<double>, channel int, extra string")
    tables.write_event(ev, str(tmp_path / "e"))
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_event(ev, str(tmp_path / "e"))
    tables.write_event(ev, str(tmp_path / "e"), overwrite=True)
    r = tables.read_event(spark, str(tmp_path / "e"), first_sample=1).first()
    assert r.samples == [2.0, 3.0] and r.t0_sec == pytest.approx(-0.01) and r.extra == "kept"
    with pytest.raises(ValueError, match="dt"):
        tables.write_event(ev.drop("dt"), str(tmp_path / "x"))


def test_catalog_files(spark, tmp_path):
    rows = [("/a b/x.h5", 5, 9, 100.0, 5, None, None, 10.0, 0), ("b", 1, 2, None, 2, 3, 1.5, float("nan"), 7)]
    df = spark.createDataFrame(rows, "file string, begin_us long, end_us long, fs double, nt long, nx int, dx double, gauge_length_m double, first_sample long")
    tables.write_catalog(df, str(tmp_path / "c.parquet"))
    assert tables.read_catalog(spark, str(tmp_path / "c.parquet")).count() == 2
    tables.write_catalog(df, str(tmp_path / "c.csv"))
    got = {r.file: (r.begin_us, r.fs, r.nx, r.gauge_length_m) for r in tables.read_catalog(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"/a b/x.h5": (5, 100.0, None, 10.0), "b": (1, None, 3, None)}
    assert tables.read_catalog(spark, str(tmp_path / "c.csv"), undo_missing=False).filter("fs = -1").count() == 1
    assert tables.catalog_format("x/y") == "csv"
    (tmp_path / "old.csv").write_text('file   startTime endTime fs nChannels  dCh GaugeLen system\n"/a b/x.h5" 2023-11-14T22:13:20+00:00   2023-11-14T22:13:21.500000+00:00 100.0 4 -1 10.0 ASN\nb 2023-11-14T22:13:20 2023-11-14T22:13:21 50.0 4 2 10.0 Proc\n')
    got = tables.read_catalog(spark, str(tmp_path / "old.csv"), system="ASN").collect()
    assert [(r.file, r.begin_us, r.end_us, r.fs, r.nx, r.dx, r.gauge_length_m, r.first_sample, r.nt, r.system) for r in got] == [("/a b/x.h5", 1_700_000_000_000_000, 1_700_000_001_500_000, 100.0, 4, None, 10.0, 0, None, "ASN")]
    assert (tmp_path / "c.csv").is_dir() and "begTime" in spark.read.text(str(tmp_path / "c.csv")).first()[0] and spark.read.text(str(tmp_path / "c.csv")).filter("value like '%1970-01-01T00:00:00.000005+00:00%'").count() == 1
    with pytest.raises(ValueError):
        tables.catalog_format("a.json")


def test_layouts_of_recordings():
    d = hdf5.decode_any(H.asn(), (1, 3), 10, 5)
    assert d["kind"] == d["origin"] == "ASN" and d["data"].shape == (2, 5) and d["data"][0, 0] == pytest.approx(-41e-8) and d["data"][1, 0] == pytest.approx(-21e-8)
    assert d["fs"] == pytest.approx(100) and d["dx"] == 4 and d["begin_us"] == 1_700_000_000_100_002 and d["units"] == "strain/s"
    assert d["raw_meta"]["acqSpec.YvsXDelay"] == "1" and d["raw_meta"]["header.name"] == "cable" and "data" not in d["raw_meta"]
    d = hdf5.decode_any(H.optasense(), first=3)
    assert d["data"].shape == (4, 253) and d["data"][1, 0] == 259 and d["begin_us"] == 1_700_000_000_030_000 and d["units"] == "count" and d["raw_meta"]["FPGA Version"] == "1.9" and d["raw_meta"]["AcquisitionId"] == "a"
    for timed in (True, False):
        d = hdf5.decode_any(H.apsensing(timed=timed), (1, None), 2, 4)
        assert d["data"].shape == (3, 4) and d["data"][0, 0] == 9 and d["begin_us"] == 1_700_000_000_008_000 and d["raw_meta"]["ProcessingServer.DataRate"] == "250.0" and d["raw_meta"]["Distances.Start"] == "5"
        d = hdf5.decode_any(H.processed(timed=timed), first=1, count=2)
        assert d["data"].tolist() == [[2, 4], [3, 5]] and d["begin_us"] == 1_700_000_000_010_000 and d["units"] == "strain/s"
    d = hdf5.decode_any(H.event(), first=1)
    assert d["data"].tolist() == [[1, 2, 3], [5, 6, 7]] and d["t0_sec"] == pytest.approx(-0.01) and d["units"] == "microstrain/s" and d["raw_meta"] == {"event_id": "e1", "magnitude": "1.5"}
    with pytest.raises(ValueError):
        hdf5.decode_any(H.Group())


def test_factors_by_origin():
    counts = -(np.pi / 2**15) * 1550e-9 / (4 * np.pi * 0.78 * 1.468 * 10)
    assert hdf5.to_strain(H.optasense()) == pytest.approx(counts) and hdf5.to_strain(H.apsensing()) == pytest.approx(1e-7) and hdf5.to_strain(H.asn()) == 1.0
    kept = dict(H.optasense()["Acquisition"].attrs) | dict(H.optasense()["Acquisition/Custom"].attrs)
    d = hdf5.decode_any(H.processed(kept), convert=True)
    assert d["origin"] == "OptaSense" and d["units"] == "microstrain" and d["data"][1, 1] == pytest.approx(3 * counts * 1e6)
    d = hdf5.decode_any(H.processed({"ProcessingServer.ClassifierVersion": 1, "ProcessingServer.RadiansToNanoStrain": 50.0}), convert=True)
    assert d["origin"] == "APSensing" and d["units"] == "microstrain/s" and d["data"][1, 1] == pytest.approx(3 * 50e-3)
    assert hdf5.decode_any(H.processed({"acqSpec.YvsXDelay": 1}))["origin"] == "ASN" and hdf5.origin_of(H.processed({"acquisition.num_channels": 1})) == "Sintela" and hdf5.origin_of(H.processed()) == "Unknown"
    assert hdf5.to_strain(H.processed({"AcquisitionId": "x"})) == 1.0  # attributes are missing
    assert hdf5.flattened({"a": {"b": 1, "c": {"d": [2]}}, "e": 3}) == {"a.b": 1, "a.c.d": [2], "e": 3}


def test_catalogs_from_headers(spark, tmp_path):
    folder = tmp_path / "rec ordings"
    H.save(folder / "20231114" / "221320.hdf5", H.asn())
    H.save(folder / "20231114" / "ch1" / "221330.hdf5", H.asn(1.7e9 + 10))
    H.save(folder / "other" / "221330.hdf5", H.asn())
    H.save(folder / "a.h5", H.optasense(hole=100))
    H.save(folder / "b.h5", H.apsensing())
    H.save(folder / "20231115" / "p.h5", H.processed())
    (folder / "broken.h5").write_bytes(b"no pickle")

    def rows(system):
        return {r.file.removeprefix(str(folder)).replace("%20", " ").rsplit("/", 1)[-1] + f":{r.first_sample}": r for r in hdf5.scan(spark, str(folder), system, None, H.opener).collect()}

    got = rows("ASN")
    assert set(got) == {"221320.hdf5:0", "221330.hdf5:0"}
    r = got["221320.hdf5:0"]
    assert (r.begin_us, r.end_us, r.nt, r.nx, r.dx, r.gauge_length_m) == (1_700_000_000_000_002, 1_700_000_002_550_002, 256, 4, 4.0, 10.0) and r.fs == pytest.approx(100)
    got = rows("OptaSense")
    assert [(got[k].nt, got[k].end_us - got[k].begin_us) for k in ("a.h5:0", "a.h5:100")] == [(100, 990_000), (156, 1_550_000)] and got["a.h5:100"].begin_us == 1_700_000_006_000_000
    assert "UnpicklingError" in got["broken.h5:None"].error and len(got) == 3
    r = rows("APSensing")["b.h5:0"]
    assert (r.nt, r.nx, r.fs, r.end_us - r.begin_us) == (256, 4, 250.0, 255 * 4000)
    r = rows("Proc")["p.h5:0"]
    assert (r.nt, r.nx, r.dx, r.end_us - r.begin_us) == (4, 2, 2.0, 30_000)
    assert hdf5.describe(H.event())[0]["dx"] == 2.0 and hdf5.describe(H.asn(), "Proc") == []
    with pytest.raises(ValueError):
        hdf5.scan(spark, str(folder), "Other")


def test_known_files_are_not_opened(spark, tmp_path):
    for i in range(3):
        H.save(tmp_path / "in" / f"f{i}.h5", H.optasense(1_700_000_000_000_000 + i * 2_560_000))
    cat = str(tmp_path / "cat.csv")
    assert jobs.load_or_build(spark, str(tmp_path / "in"), cat, "OptaSense", opener=H.opener).count() == 3
    H.save(tmp_path / "in" / "f3.h5", H.optasense(1_700_000_007_680_000))
    rows = jobs.load_or_build(spark, str(tmp_path / "in"), cat, "OptaSense", opener=H.opener)
    assert rows.count() == 4 and rows.filter("system = 'OptaSense'").count() == 4
    assert {p.name: p.read_text() for p in (tmp_path / "in").glob("*.opened")} == {f"f{i}.h5.opened": "x" for i in range(4)}


def test_time_range_from_catalog_to_samples(spark, tmp_path):
    """Three files in a row, a hole of two seconds, one more file: a window over all of them."""
    for i in (0, 1, 2):
        H.save(tmp_path / f"f{i}.h5", H.optasense(1_700_000_000_000_000 + i * 2_560_000))
    H.save(tmp_path / "f9.h5", H.optasense(1_700_000_009_680_000))
    rows = jobs.described(spark, str(tmp_path), "OptaSense", None, H.opener).withColumn("key", F.lit("k"))
    seg = C.segments(rows, "key")
    lo, hi = 1_700_000_000_500_000, 1_700_000_010_000_000
    windows = spark.createDataFrame([("k", lo, hi)], "key string, window_begin long, window_end long")
    got = R.read_range(seg, windows, "key", R.file_reader("OptaSense", opener=H.opener)).filter("channel = 2").orderBy("it").collect()
    assert [r.it for r in got] == list(range(950))
    whole = np.concatenate([np.arange(512, 768)] * 3 + [np.zeros(200), np.arange(512, 768)])
    assert [r.x for r in got] == whole[50:1000].tolist()


CAT = "file string, first_sample long, begin_us long, nt long, key string"


def test_incremental_catalog(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    listed = spark.createDataFrame([("a",), ("z",)], "file string")
    assert I.unseen(spark, listed, out).count() == 2
    for rows in ([("a", 0, 1, 10, "k"), ("b", 0, 2, 10, "k")], [("b", 0, 2, 20, "k"), ("c", 0, 3, 10, "k")]):
        spark.createDataFrame(rows, CAT).coalesce(1).write.mode("append").parquet(src)
        I.ingest(spark.readStream.schema(CAT).parquet(src), out, ck, ["begin_us"]).awaitTermination()
    assert {(r.file, r.nt) for r in I.current(spark, out).collect()} == {("a", 10), ("b", 20), ("c", 10)}
    assert [r.file for r in I.unseen(spark, listed, out).collect()] == ["z"]


def test_windows_are_given_out_once_ready(spark, tmp_path):
    src = str(tmp_path / "in")
    got = []

    def run():
        q = I.ready_windows(spark.readStream.schema(CAT).parquet(src), "key", 25).writeStream.foreachBatch(lambda df, _: got.append(sorted((r.window_begin, r.window_end) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    for begins in ([10, 0, 20], [30, 40, 5], [60, 90]):
        spark.createDataFrame([("f", 0, b, 1, "k") for b in begins], CAT).coalesce(1).write.mode("append").parquet(src)
        run()
    flat = [w for ws in got for w in ws]
    assert flat == [(0, 25), (30, 55), (60, 85)]


def test_sessions_are_given_out_once_ended(spark, tmp_path):
    src, got = str(tmp_path / "in"), []
    schema = "key string, begin_us long, end_us long, nx int, fs double"

    def run():
        q = I.sessions(spark.readStream.schema(schema).parquet(src), "key").writeStream.foreachBatch(lambda df, _: got.extend(sorted((r.begin_us, r.end_us, r.n_rows) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    row = lambda i, nx=4, at=0: ("k", at + i * 100_000, at + i * 100_000 + 90_000, nx, 100.0)
    for rows in ([row(1), row(0)], [row(2), row(0)], [row(3, 5), row(4, 5)], [row(0, 5, 900_000)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    assert got == [(0, 290_000, 3), (300_000, 490_000, 2)]


def test_a_broken_catalog_is_built_anew(spark, tmp_path):
    H.save(tmp_path / "in" / "f.h5", H.apsensing())
    for name in ("c.csv", "c.parquet"):
        (tmp_path / name).write_bytes(b"")
        assert jobs.load_or_build(spark, str(tmp_path / "in"), str(tmp_path / name), "APSensing", opener=H.opener).count() == 1


def test_stacks_over_a_catalog(spark, tmp_path):
    """Windows start anew with each segment; the stack is the mean over all pieces of all windows."""
    rng = np.random.default_rng(3)
    runs = []
    for at, n in ((0, 3), (20, 2)):  # two stretches of files of 2.56 s
        whole = rng.normal(size=(4, 256 * n)).round(3)
        for i in range(n):
            f = H.optasense(1_700_000_000_000_000 + at * 1_000_000 + i * 2_560_000)
            f["Acquisition/Raw[0]"].items_["RawData"] = H.Data(whole[:, 256 * i : 256 * (i + 1)])
            H.save(tmp_path / f"f{at}_{i}.h5", f)
        runs.append(whole.astype(np.float32).astype(float))
    seg = C.segments(jobs.described(spark, str(tmp_path), "OptaSense", None, H.opener).withColumn("key", F.lit("k")), "key")
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "ch1 int, ch2 int")
    prep = {"common_mode": False, "detrended": False, "normalise": False}
    got = {(r.ch1, r.ch2): r for r in N.catalog_stack(seg, "key", pairs, R.file_reader("OptaSense", opener=H.opener), 0.01, 3_000_000, 100, 10, prep=prep).collect()}
    pieces = []
    for whole in runs:
        for a in range(0, whole.shape[1], 300):
            part = np.gradient(whole[:, a : a + 300], 0.01, axis=1)
            pieces += [part[:, i : i + 100] for i in range(0, part.shape[1] // 100 * 100, 100)]
    for (i, j), r in got.items():
        want = np.mean([[np.sum(p[i, max(0, -k) : 100 - max(0, k)] * p[j, max(0, k) : 100 + min(0, k)]) for k in range(-10, 11)] for p in pieces], axis=0)
        assert r.nseg == len(pieces) == 12 and np.allclose(r.cc, want, rtol=1e-6, atol=1e-6 * np.abs(want).max())


def test_jobs(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.segy").write_bytes(segy.encode_file(DATA, 12_500, (2023, 318, 22, 13, 20 + i)))
    cat = str(tmp_path / "cat.parquet")
    assert jobs.load_or_build(spark, str(tmp_path / "*.segy"), cat, "SEGY").count() == 5
    (tmp_path / "f9.segy").write_bytes(segy.encode_file(DATA, 12_500, (2023, 318, 22, 13, 25)))
    assert jobs.load_or_build(spark, str(tmp_path / "*.segy"), cat, "SEGY").count() == 6
    assert jobs.load_or_build(spark, str(tmp_path / "*.segy"), str(tmp_path / "new.parquet"), "SEGY").count() == 6
    rows = jobs.list_windows(spark, cat, 2_000_000, None, None, "SEGY", None).collect()
    assert [r.begin for r in sorted(rows)] == ["2023-11-14T22:13:20.000000+00:00", "2023-11-14T22:13:22.000000+00:00"]  # the next would have to end by the last file's begin
    assert jobs.list_windows(spark, cat, 2_000_000, "2023-11-14T22:13:21", "2023-11-14T22:14:00", "SEGY", None).count() == 1
    with pytest.raises(ValueError):
        jobs.list_windows(spark, cat, 1, "2023", None, "SEGY", None)
    (tmp_path / "ev.csv").write_text("event_id,event_time\ne1,2023-11-14T22:13:21Z\ne2,2020-01-01T00:00:00\n")
    plan, counts = jobs.event_job(spark, cat, str(tmp_path / "ev.csv"), 1, 1)
    assert {r.status: r.n for r in counts.collect()} == {"extract": 1, "fail": 1} and plan.count() >= 2


def test_jobs_write_all_they_list(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(2, 1000)).astype(np.float32)
    for i in (0, 1, 2, 3, 4, 6):  # 10 s each, then a hole
        (tmp_path / f"f{i}.segy").write_bytes(segy.encode_file(x + i, 10_000, (2023, 318, 22, 13 + i // 6, 10 * i % 60)))
    cat, src, out, evs = (str(tmp_path / n) for n in ("cat.parquet", "*.segy", "proc", "events"))
    jobs.load_or_build(spark, src, cat, "SEGY")
    args = ["windows", "--catalog", cat, "--system", "SEGY", "--seconds", "20", "--all", "--list", str(tmp_path / "w.csv"), "--from", src, "--to", out, "--fmax", "4", "--order", "4"]
    jobs.main(args)
    listed = spark.read.option("header", True).csv(str(tmp_path / "w.csv"))
    made = spark.read.parquet(out)
    assert {r.file for r in listed.collect()} == {r.file for r in made.select("file").distinct().collect()} and listed.count() == 2
    assert made.count() == 4 and {len(r.samples) for r in made.collect()} == {200}
    jobs.main([*args, "--proc-catalog", str(tmp_path / "made.csv")])  # nothing is left to do
    r = tables.read_catalog(spark, str(tmp_path / "made.csv")).orderBy("begin_us").first()
    assert (r.nt, r.nx, r.fs, r.system) == (200, 2, 10.0, "Proc")
    assert spark.read.parquet(out).count() == 4
    (tmp_path / "ev.csv").write_text("event_id,event_time,magnitude\n007,2023-11-14T22:13:10Z,1.5\n8,2023-11-14T22:13:55Z,2\n9,2020-01-01T00:00:00,0\n")
    args = ["events", "--catalog", cat, "--events", str(tmp_path / "ev.csv"), "--before", "10", "--after", "6", "--list", str(tmp_path / "plan.parquet"), "--from", src, "--to", evs]
    jobs.main(args)
    jobs.main(args)
    assert spark.read.parquet(str(tmp_path / "plan.parquet")).select("event_id").distinct().count() == 2
    got = {(r.event_id, r.channel): r for r in spark.read.schema("event_id string, channel int, event_time_index long, samples array<float>, magnitude string").parquet(evs).collect()}
    assert set(got) == {("007", 0), ("007", 1), ("8", 0), ("8", 1)}
    r = got["007", 1]
    assert r.event_time_index == 1000 and r.magnitude == "1.5" and np.allclose(r.samples, np.concatenate([x[1], x[1, :600] + 1]))
    r = got["8", 0]  # 22:13:45 to 50 of one file, then a hole of ten seconds, then one second of the next
    assert r.event_time_index == 1000 and np.allclose(r.samples, np.concatenate([x[0, 500:] + 4, np.zeros(1000), x[0, :100] + 6]))


def test_registered_format(spark, tmp_path):
    from fathomline.sources import formats

    formats.register(spark)
    for name in ("b.segy", "a.segy", "x.txt"):
        (tmp_path / name).write_bytes(segy.encode_file(DATA, 4000, (2023, 318, 22, 13, 20)))
    assert [p.rsplit("/", 1)[1] for p in formats.list_files(f"{tmp_path},{tmp_path}/a.segy", (".segy",))] == ["a.segy", "b.segy"]
    df = spark.read.format("segy").option("channels", "1:3").option("first_sample", "10").option("n_samples", "5").load(str(tmp_path))
    rows = df.orderBy("file", "channel").collect()
    assert [r.channel for r in rows] == [1, 2, 1, 2] and rows[0].nt == 5 and rows[0].begin_us == 1_700_000_000_040_000
    assert np.allclose(rows[1].samples, DATA[2, 10:15])
    r = formats.SegyReader({"path": "x"})
    assert len(list(r.pushFilters([formats.GreaterThanOrEqual(("channel",), 2), formats.LessThan(("channel",), 9), formats.EqualTo(("fs",), 1)]))) == 3 and (r.low, r.high) == (2, 9)
    with pytest.raises(Exception, match="FileNotFound|No such|nothing"):
        spark.read.format("segy").load(str(tmp_path / "nothing*")).count()
