from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fathomline.functions import units as U
from fathomline.operators.units import length_unit, quantities, signal_unit, with_units


@pytest.mark.parametrize(("text", "name"), [
    ("µε/s", "microstrain/s"), ("με", "microstrain"), ("micro-strain s^-1", "microstrain/s"), ("1e-9 strain/s", "nanostrain/s"), ("10^-9 strain", "nanostrain"), ("nm/m/s", "nanostrain/s"),
    ("m/m", "strain"), ("strain (m/m)", "strain"), ("STRAIN/S", "strain/s"), ("raw counts", "count"), ("count (int32)", "count"), ("phase [rad]", "radian"), ("rad s^-1", "radian/s"), ("radian per second", "radian/s"),
    ("nano strain", "nanostrain"), ("ft", "ft"), ("inches", "in"), ("Centimeter", "cm"), ("millimetres", "mm"), ("metre", "m"), ("um/m", "microstrain"), ("x10 strange", None), ("", None), (None, None), ("n/a", None), ("unknown", None),
    ("pε", "picostrain"), ("picostrain", "picostrain"), ("µε s⁻¹", "microstrain/s"), ("10⁻⁹ strain", "nanostrain"), ("(m/s)/m", "strain/s"), ("m/(m s)", "strain/s"), ("(m/m)^2 s^-1", "strain/s"), ("yd", "yd"), ("(m", None), ("m)", None),
])
def test_written_units(text, name):
    u = U.unit_of(text)
    assert (u and U.name_of(u)) == name


@pytest.mark.parametrize(("text", "name"), [
    ("plotted in strain, stored as raw counts", "count"), ("values are nε/s, spacing in m", "nanostrain/s"), ("unit=strain s^-1; gauge in m", "strain/s"), ("[radians/sec] v2 export", "radian/s"), ("payload in m/m/s after export", "strain/s"),
    ("amplitude unit: phase [rad]", "radian"), ("second export of the day", None), ("plotted in counts", None), ("Amplitude given as nanostrain", "nanostrain"), ("samples in counts before conversion, now strain", "strain"), ("formerly radian; 10⁻⁹ strain per second", "nanostrain/s"), (None, None), ("x" * 100_000, None),
])
def test_units_in_texts(text, name):
    u = U.signal_unit_in(text)
    assert (u and U.name_of(u)) == name


@pytest.mark.parametrize(("note", "name"), [
    ("gauge in m, slack loop 40 ft", "m"), ("m (was ft before refit)", "m"), ("cm; loop of 30 ft not counted", "cm"), ("gauge logged in ft; splice at 12 m", "ft"), ("GL=1020cm", "cm"), ("52.5ft", "ft"), ("GL unit: inch", "in"), ("gauge 315 in", "in"), ("in", "in"),
    ("inch, see panel", "in"), ("mm units since refit", "mm"), ("splice box 3 cm off", None), ("re-terminated, 2 in of jacket removed", None), ("10 m", "m"), ("averages over 33 feet", "ft"), ("GL (ft)", "ft"), ("3 pm", None), ("12 yd gauge", "yd"), (None, None), ("in duct", None),
])
def test_lengths_in_notes(note, name):
    u = U.length_unit_in(note)
    assert (u and U.name_of(u)) == name


def test_values_come_out_in_common_units(spark):
    rows = [(1, "nanostrain/s", ["x"], 5000.0, None), (2, "counts", None, 10.0, 2e-6), (3, "counts", [], 10.0, None), (4, None, [None, "stored as strain"], 2.0, None), (5, "???", ["stored as strain"], 1.0, None), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, units string, notes array<string>, v double, f double").withColumn("factor", F.lit("clash"))
    out = {r.id: r for r in with_units(df, signal_unit(F.col("units"), F.col("notes")), F.col("f")).withColumn("y", F.col("v") * F.col("factor")).collect()}
    assert math.isclose(out[1].y, 5.0) and out[1].canonical_unit == "microstrain/s"
    assert math.isclose(out[2].y, 20.0) and out[3].y is None
    assert math.isclose(out[4].y, 2e6) and out[4].unit_name == "strain"
    assert out[5].unit_name is None and out[5].y is None and out[6].unit_name is None


def test_lengths_in_metres(spark):
    df = spark.createDataFrame([(1, "feet", 10.0), (2, None, 4.0), (3, "GL [mm]", 2000.0), (4, "in", 100.0)], "id int, note string, v double")
    out = {r.id: r.y for r in with_units(df, length_unit(F.col("note")), F.lit(None).cast("double")).select("id", (F.col("v") * F.col("factor")).alias("y")).collect()}
    assert [round(out[i], 6) for i in (1, 2, 3, 4)] == [3.048, 4.0, 2.0, 2.54]
    assert with_units(df.limit(0), length_unit(F.col("note")), F.lit(None).cast("double")).count() == 0


def test_numbers_with_units(spark):
    texts = ["12.5 ft", "-3e-9 strain/s", "21 °C", "68degF", "300 K", "7 nonsense", "12", None, "", "1e3 mm", "5 µε/s"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.q for r in df.select(quantities(F.col("t")).alias("q")).collect()]
    assert [q.value and round(q.value, 12) for q in got] == [3.81, -3e-9, 294.15, 293.15, 300.0, None, None, None, None, 1.0, 5e-6]
    assert [q.name for q in got[:5]] == ["ft", "strain/s", "°C", "°F", "K"] and got[2].dims == [0, 0, 0, 0, 1]
