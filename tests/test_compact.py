from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions.hilbert import hilbert_codes
from fathomline.functions.paths import canonical_path
from fathomline.operators.compact import coded, compaction_plan, file_chunks, file_sizes, place_coordinate, row_digest, time_range, write_compacted


@pytest.mark.parametrize(("bits", "dims"), [(3, 2), (2, 3), (4, 2), (2, 4)])
def test_hilbert_codes_are_a_walk_through_neighbours(bits, dims):
    side = 1 << bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    codes = hilbert_codes(points, bits)
    assert sorted(codes) == list(range(side**dims))
    walk = points[np.argsort(codes)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_every_spelling_is_one_path(spark):
    spellings = [" /a b/run1/f_1.h5", "file:///a b/run1/f_1.h5", "\\a b\\run1\\f_1.h5", "/a%20b/run1/f%5F1.h5", "/a b//run1/./f_1.H5\t", "/a b/run1/tmp/../f_1.h5", "/../a b/x/y/../../run1/f_1.h5"]
    df = spark.createDataFrame([(s,) for s in [*spellings, None, "a+b%2", "x.tar.GZ", ""]], "p string")
    got = [r[0] for r in df.select(canonical_path(F.col("p"))).collect()]
    assert set(got[:7]) == {"/a b/run1/f_1.h5"}
    assert got[7:] == [None, "a+b%2", "x.tar.gz", ""]


CATALOG = "row_id long, p string, fs0 long, n long, a string, b long, code int, prefix string"


def chunks(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CATALOG)
    return file_chunks(df, "row_id", F.col("p"), F.col("fs0"), F.col("n"), F.col("a"), F.col("b"))


def plan_of(c, target, **options):
    return compaction_plan(coded(file_sizes(c), time_range(c, F.col("b"))), target, **options)


def test_plan_holds_every_chunk_once_in_balanced_files(spark):
    rows = [(i, f"/f{i // 2}", (i % 2) * 100, 100 + i % 7, "hot" if i % 3 else "cold", i * 1_000_000) for i in range(600)]
    rows += rows[:40] + [(1000, None, 0, 5, None, None), (1001, "/f0", 0, 7, None, None), (1002, "/nulls", None, None, None, None)]
    c = chunks(spark, rows)
    plan = plan_of(c, 2000, prefix_bits=12)
    got = {r["file"]: r for r in plan.collect()}
    assert len(got) == 301 and got["/nulls"].samples == 0
    total = sum(100 + i % 7 for i in range(600))
    assert sum(r.samples for r in got.values()) == total
    spans = sorted((r.out_offset, r.samples) for r in got.values())
    assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
    per = {}
    for r in got.values():
        per[r.out_file] = per.get(r.out_file, 0) + r.samples
    assert max(per.values()) <= 2000 + 210 and min(list(per.values())[:-1] or [0]) >= 0
    assert got["/f0"].first_row_id == 0


def test_files_above_the_target_are_cut(spark):
    rows = [(i, f"/f{i}", 0, n, "a", i) for i, n in enumerate([5, 2500, 0, 700, 1000, 1001, None])]
    got = plan_of(chunks(spark, rows), 1000).collect()
    per = {}
    for r in sorted(got, key=lambda r: r.out_offset):
        assert r.out_offset // 1000 == r.out_file or r.samples <= 1000
        assert r.piece_from == per.get(r.file, 0)
        per[r.file] = per.get(r.file, 0) + r.piece_samples
    assert per == {"/f0": 5, "/f1": 2500, "/f2": 0, "/f3": 700, "/f4": 1000, "/f5": 1001, "/f6": 0}
    assert len([r for r in got if r.file == "/f1"]) >= 3


def test_like_names_lie_side_by_side(spark):
    names = ["OSLO01", "OSLO02", "OSNE07", "OTTA01", "PARI01", None, ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(place_coordinate(F.col("p"))).collect()]
    assert all(0 <= g < 1 << 16 for g in got) and got[5] == got[6]
    assert abs(got[0] - got[2]) < 64 and got[3] > max(got[:2]) - 64 and got[4] - got[3] > 64


def test_empty_catalog(spark):
    assert plan_of(chunks(spark, []), 10).collect() == []


def test_written_files_have_the_source_rows(spark, tmp_path):
    rows = [(i, f"/f{i // 2}", (i % 2) * 100, 100, "a", i * 1_000_000) for i in range(100)]
    c = chunks(spark, rows)
    plan = plan_of(c, 10, weight="chunks")
    done = write_compacted(c, plan, str(tmp_path / "out"))
    assert done["rows"] == 100
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    assert row_digest(back, *c.columns).first() == row_digest(c, *c.columns).first()
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == done["files"]
    assert row_digest(c.unionByName(c.limit(1)), *c.columns).first() != row_digest(c, *c.columns).first()
