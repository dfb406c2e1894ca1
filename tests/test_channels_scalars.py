from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import scalars as K
from fathomline.operators import channels as H


def test_channels_are_normalised(spark):
    rows = [(0, "100", "n", "good", "0", "x"), (1, "101", None, "bad", "1", "y"), (2, "102", "n", "GOOD", "zap", "z"), (3, "103", "n", "1", None, "w")]
    df = spark.createDataFrame(rows, "pos int, index string, fiber string, status string, spiky string, note string")
    out = H.normalise_channels(df, "pos").orderBy("index_raw")
    assert out.columns == ["index_raw", "fiber", "taptest", "quality", "index_taptest", "pos", "note", "lat", "lon", "ele", "azi", "dip"]
    got = [(r.index_raw, r.fiber, r.taptest, r.quality, r.index_taptest) for r in out.collect()]
    assert got == [(100, "n", 1, 1, 0), (101, "u", 0, 0, None), (102, "n", 0, 0, None), (103, "n", 1, 0, 1)]
    assert H.active(out).count() == 1 and H.located(out).count() == 2 and H.by_fiber(out, "u").count() == 1 and H.every_nth(out, 2).count() == 1
    s = H.summary(out).first()
    assert (s.n, s.n_located, s.n_active, s.fibers) == (4, 2, 1, "n,u")


def test_a_sheet_from_a_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ichan_before_taptest,taptest_channel_index,ichan_after_taptest,status,latitude,longitude,index\n7,1,5,good,1.5,2.5,70\n8,2,6,lost,2.5,3.5,80\n9,3,,good,3.5,4.5,90\n")
    out = H.read_channels(spark, str(tmp_path / "c.csv"))
    got = [(r.index_raw, r.index_taptest, r.taptest, r.lat) for r in out.orderBy("index_raw").collect()]
    assert got == [(70, 5, 1, 1.5), (80, None, 0, 2.5), (90, None, 1, 3.5)]  # index and ichan_after_taptest come first in the list of names
    (tmp_path / "d.csv").write_text("name,lat,lon\na,1,2\nb,2,3\n")
    assert [(r.name, r.index_raw, r.index_taptest, r.quality) for r in H.read_channels(spark, str(tmp_path / "d.csv")).orderBy("index_raw").collect()] == [("a", 0, 0, 1), ("b", 1, 1, 1)]
    (tmp_path / "e.csv").write_text("name,lat\na,1\n")
    with pytest.raises(ValueError, match="lon"):
        H.read_channels(spark, str(tmp_path / "e.csv"))
    traces = spark.createDataFrame([(70, "x"), (80, "y"), (99, "z")], "channel long, t string")
    assert [r.t for r in H.select_traces(traces, H.active(out)).collect()] == ["x"]
    assert H.origin(out).first().lat0 == 2.5
    with pytest.raises(Exception, match="no channel is located"):
        H.origin(out.filter("taptest = 0")).collect()


def test_aliases_give_way_to_real_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "lat int, latitude int, elevation int, longitude int")
    assert H.rename_aliases(df).columns == ["lat", "ele", "lon"]
    bare = H.normalise_channels(spark.createDataFrame([(5,), (3,)], "pos int"), "pos").orderBy("index_raw").collect()
    assert [(r.index_raw, r.pos, r.fiber, r.taptest, r.quality, r.index_taptest) for r in bare] == [(0, 3, "n", 1, 1, 0), (1, 5, "n", 1, 1, 1)]


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_units_and_factors(spark):
    assert one(spark, K.normalize_unit(F.lit("Micro" + "Strain/sec")), K.normalize_unit(F.lit("rads")), K.normalize_unit(F.lit("in Radian")), K.normalize_unit(F.lit(None).cast("string"))) == ("microstrain/s", "unknown", "radian", "unknown")
    assert one(spark, K.unit_of_rate(F.lit("strain")), K.unit_of_integral(F.lit("strain/s")), K.physical_unit(F.lit("radian/s")), K.unit_of_rate(F.lit("strain/s"))) == ("strain/s", "strain", "strain/s", "strain/s")
    f = K.count_to_strain(F.lit(1550e-9), F.lit(1.468), F.lit(10.0), F.lit(7804701), F.lit("2.0"))
    g = K.count_to_strain(F.lit(1550e-9), F.lit(1.468), F.lit(10.0), F.lit(7804701), F.lit("2.1"))
    missing = K.count_to_strain(F.lit(None).cast("double"), F.lit(1.468), F.lit(10.0), F.lit(1), F.lit("x"))
    value = (math.pi / 2**15) * 1550e-9 / (4 * math.pi * 0.78 * 1.468 * 10)
    assert one(spark, f, g, missing, K.radian_to_strain(F.lit(100.0))) == pytest.approx((-value, value, 1.0, 1e-7))
    with pytest.raises(Exception, match="no factor to strain"):
        one(spark, K.to_physical(F.array(F.lit(1.0)), F.lit("count"), F.lit(1.0)))
    assert one(spark, K.to_physical(F.array(F.lit(2.0)), F.lit("strain"), F.lit(1.0))) == ([2.0],)


def test_kinds_and_origins(spark):
    kind = lambda names, ev=False: K.data_kind(F.array(*map(F.lit, names)), F.lit(ev))
    assert one(spark, kind(["data", "acqSpec"]), kind(["Data", "Acquisition"]), kind(["Acquisition"]), kind(["ProcessingServer"]), kind(["data"], True), kind(["data"])) == ("ASN", "Proc", "OptaSense", "APSensing", "Event", "Unknown")
    meta = F.create_map(F.lit("acqSpec.YvsXDelay"), F.lit("1"))
    assert one(spark, K.data_origin(F.lit("Proc"), meta), K.data_origin(F.lit("OptaSense"), meta), K.data_origin(F.lit("Proc"), F.create_map().cast("map<string,string>"))) == ("ASN", "OptaSense", "Unknown")
    assert one(spark, K.is_segy(F.lit("a.SEGY")), K.is_segy(F.lit("a.segy.gz"))) == (True, False)


def test_times_in_names_and_texts(spark):
    us = F.lit(1_700_000_000_000_001)
    assert one(spark, K.iso_timestamp(us), K.iso_timestamp(F.lit(-1)), K.processed_name(F.lit("ASN"), us), K.processed_name(F.lit("ProcASN"), us, True)) == ("2023-11-14T22:13:20.000001+00:00", "1969-12-31T23:59:59.999999+00:00", "ProcASN-2023-11-14T221320Z.h5", "20231114/ProcASN-2023-11-14T221320Z.h5")
    assert one(spark, K.parse_iso(K.iso_timestamp(us)), K.parse_iso(F.lit("2023-11-14T22:13:20")), K.parse_iso(F.lit("2023-11-14T23:13:20+01:00")), K.parse_iso(F.lit("no"))) == (1_700_000_000_000_001, 1_700_000_000_000_000, 1_700_000_000_000_000, None)
    path = lambda p: K.dated_path_time(F.lit(p))
    assert one(spark, path("/d/20231114/x/221320.hdf5"), path("20231114/221320.hdf5"), path("/d/20231414/221320.hdf5"), path("/d/20231114/251320.hdf5"), path("/d/20231114/a.hdf5")) == (1_700_000_000_000_000, 1_700_000_000_000_000, None, None, None)


def test_hexadecimal_floats(spark):
    words = {0x42640000: 100.0, 0xC276A000: -118.625, 0x00000000: 0.0, 0x41100000: 1.0}
    df = spark.createDataFrame([(w,) for w in words], "w long")
    assert np.allclose([r[0] for r in df.select(K.ibm_float(F.col("w"))).collect()], list(words.values()))
