from __future__ import annotations

import itertools
import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions.attrs import attr_text
from fathomline.functions.stamps import readings
from fathomline.operators import stamps as O

OSLO = "Europe/Oslo"


def us(*a, tz=UTC, fold=0):
    return round(datetime(*a, tzinfo=tz, fold=fold).timestamp() * 1e6)


@pytest.mark.parametrize(("text", "expected"), [
    ("2023-05-10T02:35:01.545123Z", us(2023, 5, 10, 2, 35, 1, 545123)), ("2023-05-10T02:35:01.545123999+00:00", us(2023, 5, 10, 2, 35, 1, 545123)), ("2023-007T01:15:06.461Z", us(2023, 1, 7, 1, 15, 6, 461000)),
    ("20230510T023501Z", us(2023, 5, 10, 2, 35, 1)), ("2023/05/10 04:35:01,5", us(2023, 5, 10, 2, 35, 1, 500000)), ("10.05.2023 04:35:01.250", us(2023, 5, 10, 2, 35, 1, 250000)), ("2023-05-10 04:35:01.25+0200", us(2023, 5, 10, 2, 35, 1, 250000)),
    ("2023-05-10T04:35:01.250+02:00[Europe/Oslo]", us(2023, 5, 10, 2, 35, 1, 250000)), ("May 10, 2023 4:35:01 AM", us(2023, 5, 10, 2, 35, 1)), ("May 10, 2023 12:35:01 AM", us(2023, 5, 9, 22, 35, 1)), ("10 May 2023 04:35:01 CEST", us(2023, 5, 10, 2, 35, 1)),
    ("29 Oct 2023 02:35:01 CET", us(2023, 10, 29, 1, 35, 1)), ("1683686101", us(2023, 5, 10, 2, 35, 1)), ("1683686101.999", us(2023, 5, 10, 2, 35, 1, 999000)), ("1683686101999", us(2023, 5, 10, 2, 35, 1, 999000)), ("1683686101999123", us(2023, 5, 10, 2, 35, 1, 999123)), ("1683686101999123456", us(2023, 5, 10, 2, 35, 1, 999123)),
    ("2023-03-26 02:30:00", us(2023, 3, 26, 1, 30)),  # a time that the change skips
])
def test_one_reading(text, expected):
    assert [u for _, u, _ in readings(text, OSLO)][0] == expected and len([c for _, _, c in readings(text, OSLO) if c == 0]) == 1


@pytest.mark.parametrize("text", [None, "", " ", "N/A", "unknown", "0000-00-00T00:00:00", "2023-13-01 00:00:00", "2023-02-30T00:00:00Z", "2023-366T00:00:00Z", "12", "May 10, 2023 13:00:00 PM", "2023-05-10T02:35:01 XYZ", "x" * 100_000])
def test_no_reading(text):
    assert readings(text, OSLO) == []


def test_a_time_that_occurs_twice_has_two_readings():
    assert [u for _, u, _ in readings("2023-10-29 02:30:00", OSLO)] == [us(2023, 10, 29, 0, 30), us(2023, 10, 29, 1, 30)]
    assert len(readings("2023-10-29 02:30:00", "No/Where")) == 1


def test_readings_that_differ():
    assert [(u, c) for _, u, c in readings("10 May 2023 04:35:01 CST", "America/Chicago")] == [(us(2023, 5, 10, 10, 35, 1), 0.0), (us(2023, 5, 9, 20, 35, 1), 0.0), (us(2023, 5, 10, 9, 35, 1), 0.0)]  # there it is summer time
    assert [c for _, _, c in readings("10 Jan 2023 04:35:01 CST", "Asia/Shanghai")] == [0.0, 20.0, 20.0]
    assert [u for _, u, _ in readings("05/04/2023 10:00:00", "UTC")] == [us(2023, 4, 5, 10), us(2023, 5, 4, 10)] and len(readings("25/04/2023 10:00:00", "UTC")) == 1
    assert len(readings("05/05/2023 10:00:00", "UTC")) == 1


@given(st.integers(1_640_000_000_000_000, 1_750_000_000_000_000), st.sampled_from(["Europe/Oslo", "America/St_Johns", "Asia/Kathmandu", "Australia/Adelaide", "UTC"]))
def test_round_trip_of_local_times(t, tz):
    at = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=t)).astimezone(ZoneInfo(tz))
    assert t in [u for _, u, _ in readings(at.strftime("%Y-%m-%dT%H:%M:%S.%f"), tz)]
    assert [u for _, u, _ in readings(at.isoformat(), None)] == [t]


def test_cheapest_path_is_the_best_of_all_paths():
    rng = random.Random(2)
    for _ in range(40):
        records = [[((rng.choice("ab"),), [rng.randint(0, 5)], float(rng.randint(0, 2))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 6))]

        def cost(path):
            return sum(s[2] for s in path) + sum(O._step(a[0], a[1], b[0], b[1]) for a, b in zip(path, path[1:], strict=False))

        got = O.cheapest_path(records)
        best = min(map(cost, itertools.product(*records)))
        assert any(cost(p) == best and [s[1] for s in p] == got for p in itertools.product(*records))
    assert O.cheapest_path([]) == []


def test_evidence_and_order_settle_local_times(spark):
    rows = [(1, "r", 0, "2023-10-29 01:50:00", us(2023, 10, 29, 0, 5)), (2, "r", 1, "2023-10-29 02:10:00", us(2023, 10, 29, 0, 20)), (3, "r", 2, "2023-10-29 02:05:00", None), (4, None, None, "N/A", None), (None, None, 3, None, None)]
    df = spark.createDataFrame(rows, "id long, src string, n long, stamp string, written long").withColumn("tz", F.lit(OSLO))
    found = O.readings(F.col("stamp"), F.col("tz"))
    states = O.single_states(found, lambda t: F.when((F.col("written") - t).between(0, 1_440_000_000), 0.0).otherwise(O.AGAINST))
    out = {r.id: r.us[0] for r in O.settle(df, "id", F.col("src"), F.floor(F.col("n") / 100), F.col("n"), states, F.array("stamp")).collect()}
    assert out[1] == us(2023, 10, 28, 23, 50) and out[2] == us(2023, 10, 29, 0, 10)
    assert out[3] == us(2023, 10, 29, 1, 5)  # the earlier reading would run backwards
    assert out[4] is None and out[None] is None
    assert O.settle(df.limit(0), "id", F.col("src"), F.col("n"), F.col("n"), states, F.array("stamp")).count() == 0


def test_chunks_change_no_path(spark):
    """Sources of ambiguous records cut anywhere give one path, the one of the whole source."""
    rng = random.Random(5)
    rows, want = [], {}
    for src in range(12):
        records = []
        for n in range(30):
            states = [{"forms": [rng.choice("ab")], "us": [rng.randint(0, 9)], "cost": float(rng.randint(0, 2))} for _ in range(rng.choice([1, 2, 3, 3]))]
            if rng.random() < 0.1:
                states = [{"forms": [None], "us": [None], "cost": 0.0}]
            rows.append((100 * src + n, f"s{src}" if src else None, n, states))
            records.append([(tuple(s["forms"]), s["us"], s["cost"]) for s in states])
        there = [i for i, r in enumerate(records) if r[0][1] != [None]]
        path = [records[i] for i in there]
        got = O.cheapest_path(path)
        chosen = [next(s for s in r if s[1] == u) for r, u in zip(path, got, strict=True)]
        assert len(chosen) == len(path)
        want[f"s{src}" if src else None] = there, path
    df = spark.createDataFrame(rows, "id long, src string, n long, states array<struct<forms:array<string>,us:array<long>,cost:double>>")

    def cheapest(path, times):
        """Least cost of the states that have these times."""
        return min_cost([[s for s in r if s[1] == t] for r, t in zip(path, times, strict=True)])

    def min_cost(path):
        return min(min(x) for x in O.through(path))

    for size in (1, 3, 7, 100):
        got = {r.id: r.us for r in O.settle(df, "id", F.col("src"), F.floor(F.col("n") / size), F.col("n"), F.col("states"), F.array(F.lit("x"))).collect()}
        assert len(got) == len(rows)
        for src, (there, path) in want.items():
            base = 100 * int(src[1:]) if src else 0
            assert cheapest(path, [got[base + i] for i in there]) == pytest.approx(min_cost(path)), (size, src)


def test_the_order_settles_what_no_evidence_does(spark):
    """Local times of a repeated hour, and abbreviations of two meanings, told by the records before and after; without the path's costs they come out otherwise."""
    local = [(i, "oslo", i, f"2023-10-29 0{h}:{m:02d}:00", OSLO) for i, (h, m) in enumerate([(2, 10), (2, 40), (2, 5), (2, 35), (3, 0)])]
    abbr = [(10 + i, "x", i, t, "UTC") for i, t in enumerate(["2023-01-10T03:00:00Z", "10 Jan 2023 11:20:00 CST", "2023-01-10T03:40:00Z"])]
    df = spark.createDataFrame(local + abbr, "id long, src string, n long, stamp string, tz string")
    states = O.single_states(O.readings(F.col("stamp"), F.col("tz")), lambda t: F.lit(0.0))

    def settled():
        return {r.id: r.us[0] for r in O.settle(df, "id", F.col("src"), F.floor(F.col("n") / 2), F.col("n"), states, F.array("stamp")).collect()}

    got = settled()
    assert [got[i] for i in range(5)] == [us(2023, 10, 29, *hm) for hm in ((0, 10), (0, 40), (1, 5), (1, 35), (2, 0))]
    assert got[11] == us(2023, 1, 10, 3, 20)


def test_attributes_keep_their_text(spark):
    texts = ['{"StartTime": 1641096637.000}', '{"a": 1, "begin_time": ["x"]}', '{"startTime": null, "begTime": "y"}', "{}", "no json", "[1]", None]
    df = spark.createDataFrame([(t,) for t in texts], "attrs string")
    assert [r[0] for r in df.select(attr_text(F.col("attrs"), "(start|begin|beg)time")).collect()] == ["1641096637.000", "x", "y", None, None, None, None]
