from __future__ import annotations

import math

from pyspark.sql import functions as F

from fathomline.operators.grid import counter_grid
from fathomline.operators.intervals import coverage_gaps

MIN = 60_000_000
SCHEMA = "run long, file string, b long, rate double, first long, n long, m int"


def grid(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    e = F.col("b") + F.rint((F.col("n") - 1) * 1e6 / F.col("rate")).cast("long")
    gaps = coverage_gaps(df, "run", F.col("b"), e, F.lit(2.5e6) / F.col("rate"))
    out = counter_grid(df, gaps, "run", F.col("file"), F.col("b"), F.col("rate"), F.col("first"), F.col("n"))
    return {(r["run"], r["cell_no"]): r for r in out.collect()}


def test_counts_are_spread_and_empty_minutes_marked(spark):
    rows = [(1, "a", 30_000_000, 10.0, 0, 600), (1, "b", 5 * MIN + 1, 10.0, 0, 300), (2, "c", 0, 10.0, 0, 5)]
    out = grid(spark, rows)
    assert {k for k, r in out.items() if r.status == "empty"} == {(1, 2), (1, 3), (1, 4)}
    assert math.isclose(out[1, 0].samples, 300) and math.isclose(out[1, 1].samples, 300)
    assert out[1, 0].status == "full" and out[1, 1].status == "partial"
    assert math.isclose(sum(r.samples for r in out.values()), 905)


def test_brute_force_of_empty_minutes(spark):
    rows, seen = [], {}
    at = 17_000_000
    for i, (gap, n) in enumerate([(0, 200), (100, 50), (61, 700), (200, 1), (59, 1300), (180, 20)]):
        at += gap * 1_000_000
        rows.append((7, f"f{i}", at, 10.0, 0, n))
        seen |= {(at + k * 100_000) // MIN: 1 for k in range(n)}
        at += (n - 1) * 100_000
    out = grid(spark, rows)
    expected = {m for m in range(min(seen), max(seen)) if m not in seen}
    assert {k[1] for k, r in out.items() if r.status == "empty"} == expected
    assert {k[1] for k in out} == set(range(min(seen), max(seen) + 1))


def test_resets_holes_repeats_and_nulls(spark):
    rows = [(1, "a", 0, 10.0, 0, 100), (1, "a", 0, 10.0, 0, 60), (1, "a", 20_000_000, 10.0, 200, 100), (1, "a", 40_000_000, 10.0, 0, 50), (None, "a", 0, 10.0, 0, 5), (1, None, 50_000_000, 10.0, None, 10), (1, "z", None, 10.0, 0, 10), (1, "z", 1, None, 0, 10)]
    out = grid(spark, rows)
    assert set(out) == {(1, 0)}
    assert math.isclose(out[1, 0].samples, 260) and math.isclose(out[1, 0].lost, 100)  # the counter ran on over the first hole, and was reset before the next
    assert grid(spark, []) == {}
