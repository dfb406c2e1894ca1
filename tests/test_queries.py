from __future__ import annotations

import importlib.util
import sys

import pytest

import __spark_entry__ as entry
from fathomline import queries

from .tables import SMALL, variant

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
DEALT = [n for n in queries.queries() if n[0] == "p" and n[1].isdigit()]
COLUMNS = {"p1_found": ["run_id bigint", "gap_from_us bigint", "gap_to_us bigint"], "p2_found": ["src string", "rec_id bigint", "unit string"], "p3_found": ["src string", "rec_id bigint", "stamp_field string", "utc_us bigint"], "p4_found": ["run_id bigint", "minute_no bigint"], "p5_found": ["src string", "file string", "change_kind string", "old_name string", "new_name string"], "p6_found": ["src string", "rec_id bigint", "pos int"], "p7_found": ["first_row_id bigint"]}


KEPT: dict = {}


def rows(spark, name, sf):
    if (name, sf) not in KEPT:
        KEPT[name, sf] = sorted(map(str, queries.queries()[name](spark, sf).collect()))
    return KEPT[name, sf]


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_tables_without_content(spark, tmp_path, kind):
    sf = variant(spark, kind, tmp_path)
    for name in DEALT:
        got = queries.queries()[name](spark, sf).collect()
        if name.endswith("_found"):
            assert got == [], name


def test_extra_columns_change_nothing(spark, tmp_path):
    sf = variant(spark, "extra", tmp_path)
    for name in DEALT:
        assert rows(spark, name, sf) == rows(spark, name, str(SMALL)), name


def test_repeated_and_null_rows(spark, tmp_path):
    sf = variant(spark, "mixed", tmp_path)
    for name in DEALT:
        got, base = set(rows(spark, name, sf)), set(rows(spark, name, str(SMALL)))
        if name in ("p1_found", "p1_periods", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found"):
            assert got == base, name


def test_columns_are_those_asked_for(spark):
    for name, cols in COLUMNS.items():
        assert [f"{c} {k}" for c, k in queries.queries()[name](spark, str(SMALL)).dtypes] == cols


def test_rows_equal_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in SMALL.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")

    def plain(v):
        return format(v, ".9g") if isinstance(v, float) else str(v)

    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, str(SMALL))
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns), name
        at = [rel.columns.index(c) for c in df.columns]
        want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
        assert sorted(tuple(map(plain, r)) for r in df.collect()) == want, name


def test_ibm_words_of_every_exponent_are_compared(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.range(0, 65536, 97).withColumnRenamed("id", "row_id").write.parquet(str(tmp_path / "das_catalog.parquet"))
    con = duckdb.connect()
    con.execute(f"create view das_catalog as select * from '{tmp_path}/das_catalog.parquet/*.parquet'")
    got = sorted(map(tuple, queries.queries()["ibm_words"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(queries.oracle_sql()["ibm_words"]).fetchall())
    assert len(got) == 676 and {r[1] for r in got} == set(range(128))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_works_without_the_text_package(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "fathomline.llm" else found(name, *a))
    assert set(entry.queries()) == set(queries.queries())
    loaded = [m for m in sys.modules if m.startswith("fathomline.") and not m.startswith("fathomline.llm")]
    assert not [m for m in loaded if any(getattr(v, "__module__", "").startswith("fathomline.llm") for v in vars(sys.modules[m]).values() if callable(v))]
