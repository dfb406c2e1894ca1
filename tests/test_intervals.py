from __future__ import annotations

import random

from pyspark.sql import functions as F

from fathomline.operators.intervals import coverage_gaps, coverage_periods
from fathomline.operators.times import resolve_times

SCHEMA = "run_id long, b long, e long, tol double, k string, s int, gaps int"


def brute(rows):
    gaps, periods = [], []
    runs = {}
    for r in rows:
        if None not in r[:3] and r[2] >= r[1]:
            runs.setdefault(r[0], []).append((r[1], r[2], r[3] or 0.0))
    for run, iv in runs.items():
        iv.sort()
        start, last = iv[0][0], (iv[0][1], iv[0][2])
        for b, e, tol in iv[1:]:
            if b - last[0] > last[1]:
                gaps.append((run, last[0], b))
                periods.append((run, start, last[0]))
                start = b
            last = max(last, (e, tol))
        periods.append((run, start, last[0]))
    return sorted(gaps), sorted(periods)


def both(spark, rows, shard, block):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    args = ("run_id", F.col("b"), F.col("e"), F.col("tol"), shard, block)
    return sorted(map(tuple, coverage_gaps(df, *args).collect())), sorted(map(tuple, coverage_periods(df, *args).collect()))


def test_random_intervals_match_a_plain_walk(spark):
    rng = random.Random(5)
    rows = []
    for run in range(6):
        for _ in range(rng.randint(1, 60)):
            b = rng.randint(0, 3000)
            rows.append((run, b, b + rng.choice([0, 1, 5, 40, 700]), rng.choice([0.0, 2.5, 10.0, None])))
    rows += rows[:20]  # repeated rows
    for shard, block in ((10, 3), (97, 512), (100_000, 512)):
        assert both(spark, rows, shard, block) == brute(rows)


def test_nulls_reversed_intervals_and_empty_tables(spark):
    rows = [(None, 1, 2, 0.0), (1, None, 5, 0.0), (1, 5, None, 0.0), (1, 9, 3, 0.0), (2, 7, 7, None)]
    assert both(spark, rows, 10, 4) == ([], [(2, 7, 7)])
    assert both(spark, [], 10, 4) == ([], [])


def test_one_hot_entity_is_spread_over_its_shards(spark):
    rows = [(1, i * 10, i * 10 + 9, 1.5) for i in range(3000) if i % 100]
    gaps, periods = both(spark, rows, 50, 7)
    assert (gaps, periods) == brute(rows)
    assert len(gaps) == 29


def test_missing_value_follows_from_the_other_three(spark):
    rows = [("2022-01-01 00:00:00", "2022-01-01 00:00:09.99", 100.0, 1000), (None, "2022-01-01 00:00:09.99", 100.0, 1000), ("2022-01-01 00:00:00", None, 100.0, 1000), ("2022-01-01 00:00:00", "2022-01-01 00:00:09.99", float("nan"), 1000), ("2022-01-01 00:00:00", "2022-01-01 00:00:09.99", 0.0, 1000), ("2022-01-01 00:00:00", "2022-01-01 00:00:09.99", 100.0, -1)]
    df = spark.createDataFrame(rows, "begin_time string, end_time string, fs double, nt long").withColumns({c: F.col(c).cast("timestamp") for c in ("begin_time", "end_time")})
    out = {(r.b_us, r.e_us, r.rate, r.n) for r in resolve_times(df.withColumn("rate", F.lit("clash"))).collect()}
    b = 1_640_995_200_000_000
    assert out == {(b, b + 9_990_000, 100.0, 1000)}
