from __future__ import annotations

import pytest

from fathomline.llm import queries

from ..tables import SMALL, variant

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")


def rows(spark, name, sf):
    return sorted(map(str, queries.queries()[name](spark, sf).collect()))


@pytest.mark.parametrize("kind", ["empty", "nulls", "mixed"])
def test_tables_with_little_content(spark, tmp_path, kind):
    sf = variant(spark, kind, tmp_path)
    for name, query in queries.queries().items():
        got = query(spark, sf).collect()
        if kind == "empty":
            assert got == [], name
        if name == "p8_ids":
            assert all(r.ids is not None for r in got)
        if name == "p10_found" and kind == "mixed":
            assert {(r.doc_id_a, r.doc_id_b) for r in got} == {(r.doc_id_a, r.doc_id_b) for r in query(spark, str(SMALL)).collect()}


def test_extra_columns_change_nothing(spark, tmp_path):
    sf = variant(spark, "extra", tmp_path)
    for name in queries.queries():
        assert rows(spark, name, sf) == rows(spark, name, str(SMALL)), name


def test_columns_are_those_asked_for(spark):
    kinds = {n: queries.queries()[n](spark, str(SMALL)).dtypes for n in ("p8_ids", "p10_found")}
    assert kinds == {"p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")]}


def test_rows_equal_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, str(SMALL))
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall()), name
