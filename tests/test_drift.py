from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import columns as C
from fathomline.operators import drift as D
from fathomline.queries import drift_problems as Q

from .tables import SMALL


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 5), (5, 2), (4, 4), (6, 6)):
        gain = rng.random((n, m))
        pairs = C.assignment(gain)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
        small, wide = (gain, m) if n <= m else (gain.T, n)
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide), len(small)))
        assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def one(name, kind, value):
    return C.Profile(name, kind, int(value is not None), int(value is not None), value=value)


def changes(old, new, together=0.0, expected=0.0, handed=0, compared=0):
    scored = [(c.old, c.new, C.likeness(c, together, expected, handed, compared)) for c in C.candidates(old, new)]
    return C.changes(old, new, C.renames(scored))


def test_single_values():
    assert changes([one("dCh", "fractional", "1")], [one("polarity", "integer", "1")]) == [("removed", "dCh", ""), ("added", "", "polarity")]
    assert changes([one("nCh", "integer", "2400")], [one("NumChannels", "list", "2400")]) == [("renamed", "nCh", "NumChannels"), ("retyped", "nCh", "NumChannels")]
    assert changes([one("GaugeLength", None, None)], [one("GaugeLen", "fractional", "10")]) == [("renamed", "GaugeLength", "GaugeLen")]
    assert changes([one("splice", None, None)], [one("azi", None, None)]) == [("removed", "splice", ""), ("added", "", "azi")]
    assert changes([], [one("a", None, None)]) == [("added", "", "a")] and changes([], []) == []


def test_what_the_corpus_says_of_two_names():
    laser, optical = [one("laserPower", "fractional", "12.5")], [one("opticalOut", "fractional", "13.9")]
    assert changes(laser, optical)[0][0] == "removed"  # no equal value, no like name
    assert changes(laser, optical, handed=9, compared=9) == [("renamed", "laserPower", "opticalOut")]
    assert changes(laser, [one("opticalOut", "fractional", "12.5")], expected=50)[0][0] == "renamed"
    assert changes(laser, [one("opticalOut", "fractional", "12.5")], together=0.5)[0][0] == "removed"  # they stand in one version elsewhere


def test_begin_and_end_are_told_by_their_order():
    old = [one("startTime", "text", "2024-01-01T00:00:00Z"), one("endTime", "text", "2024-01-01T00:10:00Z")]
    new = [one("begTime", "text", "2024-01-01 00:10:00"), one("stopTime", "integer", "1704068400")]
    got = changes(old, new)
    assert sorted(got) == [("renamed", "endTime", "stopTime"), ("renamed", "startTime", "begTime"), ("retyped", "endTime", "stopTime")]


def versions(spark, rows):
    df = spark.createDataFrame(rows, "id long, run string, no long, file string, attrs string").withColumns({"prev": F.lit("clash"), "sig": F.lit(1), "kind": F.lit("x")})
    return D.attr_versions(df, "run", "no", "id", "file", "attrs")


def test_headers(spark):
    rows = [
        (1, "r", 0, "f0", '{"nCh": 10, "fs": 100.0, "x": null}'), (2, "r", 1, "f1", '{"fs": 100, "nCh": 10, "x": 5}'), (9, "r", 1, "late", '{"other": 1}'), (3, "r", 3, "f3", '{"fs": [100], "nChannels": "10", "chain": "c"}'),
        (4, "r", 4, "f4", None), (5, "q", 0, "g0", "{}"), (6, "q", 5000, "g1", '{"a": true}'), (7, None, 1, "n", '{"a": 1}'), (8, "q", None, "n", '{"a": 1}'), (10, "q", 5001, "g2", '{"a": 1, "a": 2}'), (11, "q", 5002, "g3", "[1"),
    ]
    df = versions(spark, rows)
    want = sorted([
        ("f1", "retyped", "fs", "fs"), ("f3", "retyped", "fs", "fs"), ("f3", "renamed", "nCh", "nChannels"), ("f3", "retyped", "nCh", "nChannels"), ("f3", "added", "", "chain"), ("f3", "removed", "x", ""),
        ("f4", "removed", "fs", ""), ("f4", "removed", "nChannels", ""), ("f4", "removed", "chain", ""), ("g1", "added", "", "a"), ("g3", "removed", "a", ""),
    ])
    for chunk in (1, 2, 4096):
        got = D.version_changes(df, chunk).select("file", "change_kind", "old_name", "new_name")
        assert sorted(map(tuple, got.collect())) == want, chunk
    assert D.version_changes(df.limit(0)).count() == 0


def test_sheets(spark):
    def sheet(no, f):
        return [("r", no, f"s{no}", i, f(i)) for i in range(40)]

    flag = lambda i, words: words[i * i % 7 > 2]
    rows = sheet(0, lambda i: {"index_raw": str(i), "lat": None if i % 3 else f"{i}.5", "empty": "", "tap": flag(i, "10"), "gain": "7"})
    rows += sheet(1, lambda i: {"index_raw": f"ch{i}", "latitude": "" if i % 3 else f" {i}.5 ", "empty": None, "status": flag(i, ("fine", "poor")), "azi": str(i % 5)})
    rows += sheet(2, lambda i: {"index_raw": f"ch{i}", "latitude": "7", "empty": "1.0", "status": flag(i, ("fine", "poor")), "azi": str(i % 5)})
    rows += rows[:5] + [("r", 3, "s3", 0, None), (None, 0, "n", 0, {"a": "1"})]
    df = spark.createDataFrame(rows, "run string, no long, file string, row_no int, cells map<string,string>").withColumn("v", F.lit(1))
    changes, sets = D.changes_of(D.cell_versions(df, "run", "no", "file", "row_no", "cells"))
    want = [("s1", "renamed", "lat", "latitude"), ("s1", "retyped", "index_raw", "index_raw"), ("s1", "renamed", "tap", "status"), ("s1", "retyped", "tap", "status"), ("s1", "removed", "gain", ""), ("s1", "added", "", "azi"), ("s2", "retyped", "latitude", "latitude")]
    assert sorted(map(tuple, changes.select("file", "change_kind", "old_name", "new_name").collect())) == sorted(want)
    families = D.column_families(changes, sets)
    assert families["lat"] == families["latitude"] and families["tap"] == families["status"] and len(set(families.values())) == 6
    types = D.column_types(df.select("cells"), families)
    assert types == {"azi": "bigint", "empty": "double", "gain": "bigint", "index_raw": "bigint", "latitude": "double", "status": "string"}
    out = df.filter("no < 2").select("no", "row_no", *D.unified(F.col("cells"), families, types))
    assert out.filter("row_no = 3").select("latitude", "index_raw").distinct().count() == 1  # '3.5' and ' 3.5 ', '3' and 'ch3'


def test_a_rename_seen_once_joins_a_family(spark):
    rows = [("renamed", "dCh", "dx"), ("renamed", "dx", "dx_m"), ("renamed", "dx", "gain"), ("renamed", "dx", "gain"), ("renamed", "gain", "gain_db"), ("added", "", "chain")]
    changes = spark.createDataFrame(rows, "change_kind string, old_name string, new_name string")
    names = [["dCh", "gain", "fs"]] * 3 + [["dx", "gain_db"], ["dx_m", "gain", "chain"], ["dx", "gain"], ["Fs", "chain"]]
    sets = spark.createDataFrame([("proc", n, 10) for n in names], "kind string, names array<string>, n long")
    families = D.column_families(changes, sets)
    assert len({families[n] for n in ("dCh", "dx", "dx_m")}) == 1 and families["gain"] == families["gain_db"] != families["dCh"]
    assert families["Fs"] == "fs" and families["chain"] == "chain"
    assert D.column_families(changes.limit(0), sets.limit(0)) == {}


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
def test_no_filled_value_vanishes(spark):
    filled = lambda m: F.size(F.map_filter(m, lambda _, v: F.trim(v) != ""))
    for name, tab, values, keys in (("p5_headers", "proc_headers", F.from_json("attrs", "map<string,string>"), 4), ("p5_sheets", "sheet_rows", F.col("cells"), 5)):
        want = spark.read.parquet(str(SMALL / f"{tab}.parquet")).select(F.sum(F.when(values.isNotNull(), filled(values)))).first()[0]
        out = Q.QUERIES[name](spark, str(SMALL))
        got = out.select(F.sum(sum(F.col(n).isNotNull().cast("int") for n in out.columns[keys:-1]))).first()[0]
        assert got == want, name


def test_values_of_no_column_are_kept(spark, tmp_path):
    attrs = ['{"nCh": 5, "laser": "on", "note": " ", "file": "x", "at": 1706947737.0}', '{"nCh": 5, "nch": 6, "fs": 100}', '{"nCh": [7], "nch": 7, "fs": [1, 2]}', None]
    spark.createDataFrame([(i, 1, f"f{i}", i, a) for i, a in enumerate(attrs)], "hdr_id long, run_id long, file string, file_no int, attrs string").write.parquet(str(tmp_path / "proc_headers.parquet"))
    got = {r[0]: (r.nCh, r.laser, r.file, r.file_value, r.at) for r in Q.p5_headers(spark, str(tmp_path)).collect()}
    assert got == {0: (5, "on", "f0", "x", 1706947737.0), 1: (5, None, "f1", None, None), 2: (7, None, "f2", None, None), 3: (None, None, "f3", None, None)}
    cells = [{"lat": "1", "depth": "3"}, {"lat": "", "latitude": "2", "depth": None}]
    spark.createDataFrame([(i, 1, "s", 0, i, c) for i, c in enumerate(cells)], "sheet_row_id long, run_id long, sheet_file string, sheet_no int, row_no int, cells map<string,string>").write.parquet(str(tmp_path / "sheet_rows.parquet"))
    got = {r.sheet_row_id: (r.lat, r.latitude, r.depth, r.others) for r in Q.p5_sheets(spark, str(tmp_path)).collect()}
    assert got == {0: (1, None, 3, "{}"), 1: (None, 2, None, "{}")}
