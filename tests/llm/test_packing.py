from __future__ import annotations

import math
import random

import pytest

from fathomline.llm.packing import best_fit, packed


def loads(placed, n):
    load = [0] * n
    for size, lo, hi, pack in placed:
        for k in range(hi - lo):
            load[pack + k] += size
    return load


def test_every_item_is_placed_once_and_packs_hold():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 512):
        for _ in range(20):
            histogram = {s: rng.randint(1, 40) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 50)))}
            placed, n = best_fit(histogram, capacity)
            load = loads(placed, n)
            assert max(load) <= capacity and min(load) > 0
            for size, count in histogram.items():
                ranks = sorted(r for s, lo, hi, _ in placed if s == size for r in range(lo, hi))
                assert ranks == list(range(count))


def test_placements_are_bounded_by_the_capacity():
    rng = random.Random(6)
    for capacity in (8, 50, 300):
        for _ in range(15):
            histogram = {s: rng.choice([1, 3, 1000, 10**9]) + rng.randint(0, 50) for s in range(1, capacity + 1) if rng.random() < 0.8}
            placed, _ = best_fit(histogram, capacity)
            assert len(placed) <= (3 * len(histogram) + 2) * capacity * (1 + math.log(capacity))


def plain_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_no_worse_than_plain_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(400)]
        histogram = {s: sizes.count(s) for s in set(sizes)}
        assert best_fit(histogram, 100)[1] <= plain_best_fit(sizes, 100) * 1.02 + 1


def test_pages_are_whole_unless_larger_than_a_pack(spark):
    rng = random.Random(4)
    counts = [(i, rng.choice([0, 1, 3, 9, 10, 11, 25, 30, None])) for i in range(300)] + [(None, 4), (7, 4), (7, 4)] + [(1000 + i, 5) for i in range(400)]
    df = spark.createDataFrame(counts, "doc_id long, tokens long")
    rows = packed(df, "doc_id", [("s", 10), ("l", 64)]).collect()
    for name, capacity in (("s", 10), ("l", 64)):
        mine = [r for r in rows if r.pack_name == name]
        load = {}
        for r in mine:
            load[r.pack_no] = load.get(r.pack_no, 0) + r.size
        assert max(load.values()) <= capacity
        assert sum(load.values()) == sum(n or 0 for _, n in counts)
        assert sorted(load) == list(range(len(load)))
        assert sum(load.values()) / (len(load) * capacity) > 0.95
        pages = {}
        for r in mine:
            pages.setdefault(r.doc_id, []).append((r.piece_no, r.token_from, r.size))
        for i, n in counts:
            if i not in (7, None):
                expected = max(1, -(-(n or 0) // capacity))
                assert len(pages[i]) == expected and sum(s for _, _, s in pages[i]) == (n or 0)
                assert all(f == k * capacity for k, f, _ in pages[i])
    assert packed(df.limit(0), "doc_id", [("s", 10)]).count() == 0
    assert packed(df.filter("tokens = 0"), "doc_id", [("s", 10)]).count() == sum(n == 0 for _, n in counts)
    with pytest.raises(ValueError):
        packed(df, "doc_id", [("s", 0)])
