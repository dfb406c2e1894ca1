"""Filling containers of fixed capacity: bulk-synchronous best fit.

Items are whole numbers of tokens, so both the items still to place and the
gaps of the open packs are kept range-sorted and run-length coded: (size, how
many items) and (gap, ranges of pack numbers). The sweep goes from the largest
size down. In a round all waiting items of a size meet their successor among the
gaps (the least gap they fit in); where they are more than its packs, the lower
ranks win and the others wait; gaps are updated, and rounds repeat until no gap
is left for the size, whose rest opens packs. The histogram of sizes has as many
rows as the capacity has tokens, and the placements follow it, whatever the
data's size; so the sweep itself runs on the driver.

What grows with the data stays distributed: token counts, the histogram, the
rank of each item within its size (by hash shards of each size, as many as the
items need, so a size held by a third of all items is many tasks), and the lookup of a rank's pack.

Defined results: without pack sizes there are no packs; null and empty texts are pages of 0 tokens and ride in the
pack that their key's hash names; a page above the capacity is cut into full pieces
and a rest; repeated rows are items of their own; an empty table gives none; a
capacity below 1 is an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

PER_SHARD = 1_000_000  # items of one size in one window task, about


def best_fit(histogram: dict[int, int], capacity: int, first_pack: int = 0) -> tuple[list[tuple[int, int, int, int]], int]:
    """Placements (size, rank from, rank to, pack of the first) and the number of the next free pack.

    Items of a size are ranks 0, 1, ...; rank r of a placement goes into pack
    ``pack of the first + r - rank from``.

    Bound, whatever the histogram's counts: open packs lie in ranges. A size that
    meets ranges takes whole ones, which stay single ranges of a smaller gap, and
    of one at most a part, which makes one range more; its new packs make two
    more. So there are 3 S ranges at most, S being the number of sizes, and S is at
    most the capacity C. A range is met by a size at most as often as its gap
    holds it, which adds up to C(1 + ln C) over all sizes, and new packs make 2 C / size placements of a
    size. So there are at most 3 S C (1 + ln C) + 2 C (1 + ln C) placements: they
    grow with the capacity, never with the items.
    """
    gaps: dict[int, list[list[int]]] = {}  # gap -> ranges of packs
    order: list[int] = []  # gaps that have packs, sorted
    placed: list[tuple[int, int, int, int]] = []
    pack = first_pack

    def leave(gap: int, lo: int, hi: int) -> None:
        if gap <= 0 or lo >= hi:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append([lo, hi])

    for size in sorted((s for s, n in histogram.items() if s > 0 and n > 0), reverse=True):
        rank, left = 0, histogram[size]
        while left and (at := bisect_left(order, size)) < len(order):  # a round: all items of this size against its successor gap
            gap = order[at]
            ranges = gaps[gap]
            while left and ranges:
                lo, hi = ranges.pop()
                take = min(left, hi - lo)
                placed.append((size, rank, rank + take, lo))
                rank, left = rank + take, left - take
                if lo + take < hi:
                    ranges.append([lo + take, hi])
                leave(gap - size, lo, lo + take)
            if not ranges:
                del gaps[gap]
                order.remove(gap)
        # no gap is left for the others: new packs, each with as many of this size as it holds
        each = capacity // size
        full, rest = divmod(left, each)
        for _ in range(each if full else 0):
            placed.append((size, rank, rank + full, pack))
            rank += full
        leave(capacity - each * size, pack, pack + full)
        pack += full
        for _ in range(rest):
            placed.append((size, rank, rank + 1, pack))
            rank += 1
        leave(capacity - rest * size, pack, pack + bool(rest))
        pack += bool(rest)
    return placed, pack


def pieces(counts: DataFrame, key: str, packs: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, capacity, key, piece_no, token_from, size): pages, cut only above the capacity."""
    n, cap = F.col("tokens"), F.col("capacity")
    sizes = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for name, c in packs])
    rows = counts.withColumn("p", F.explode(sizes.cast("array<struct<pack_name:string,capacity:bigint>>")))
    rows = rows.select(F.col(key).alias("key"), "tokens", F.col("p.pack_name").alias("pack_name"), F.col("p.capacity").alias("capacity"))
    rows = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(n / cap) - 1, F.lit(0)))))
    start = F.col("piece_no") * cap
    return rows.select("pack_name", "capacity", "key", "piece_no", start.alias("token_from"), F.least(n - start, cap).alias("size"))


def packed(counts: DataFrame, key: str, packs: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, key, piece_no, token_from, size, pack_no) of every page or piece.

    ``counts`` has (key, tokens) and is read more than once: cut its lineage first.
    """
    if any(c < 1 for _, c in packs) or len(dict(packs)) < len(packs):
        raise ValueError("pack sizes have a name each and a capacity of at least one token")
    counts = counts.withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint"))
    shards = max(1, -(-counts.count() // PER_SHARD)) * 8
    items = pieces(counts, key, packs).withColumn("shard", F.pmod(F.xxhash64("key", "piece_no"), F.lit(shards)))

    shards = items.groupBy("pack_name", "size", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pack_name", "size").orderBy("shard")
    shards = shards.withColumn("at", F.sum("n").over(before) - F.col("n"))
    histogram: dict[str, dict[int, int]] = {name: {} for name, _ in packs}
    for r in shards.groupBy("pack_name", "size").agg(F.sum("n").alias("n")).collect():  # bounded by the capacities
        histogram[r["pack_name"]][r["size"]] = r["n"]
    rows, total = [], {}
    for name, capacity in packs:
        placed, total[name] = best_fit(histogram[name], capacity)
        rows += [(name, *p) for p in placed]

    w = Window.partitionBy("pack_name", "size", "shard").orderBy("key", "piece_no")
    ranked = items.join(shards.select(F.col("pack_name").alias("_p"), F.col("size").alias("_s"), F.col("shard").alias("_h"), "at"), (F.col("pack_name") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.col("shard") == F.col("_h")))
    ranked = ranked.withColumn("rank", F.col("at") + F.row_number().over(w) - 1)
    return _looked_up(ranked, rows, total).select("pack_name", F.col("key").alias(key), "piece_no", "token_from", "size", "pack_no")


def _looked_up(ranked: DataFrame, placed: list[tuple], total: dict[str, int]) -> DataFrame:
    """The pack of each (pack_name, size, rank) by binary search in the placements."""
    table: dict[tuple[str, int], tuple[list[int], list[int]]] = {}
    for name, size, lo, _, pack in sorted(placed):
        froms, at = table.setdefault((name, size), ([], []))
        froms.append(lo)
        at.append(pack - lo)
    shared = ranked.sparkSession.sparkContext.broadcast({k: (np.array(a), np.array(b)) for k, (a, b) in table.items()})

    @F.pandas_udf(LongType())
    def pack_of(name: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.full(len(rank), -1, np.int64)
        for k, at in pd.Series(np.arange(len(rank))).groupby([name.to_numpy(), size.to_numpy()]).indices.items():
            if k in shared.value:
                froms, shift = shared.value[k]
                r = rank.to_numpy()[at]
                out[at] = r + shift[np.searchsorted(froms, r, side="right") - 1]
        return pd.Series(out)

    empty = F.coalesce(F.lit(None).cast("bigint"), *[F.when(F.col("pack_name") == name, F.when(F.lit(n) > 0, F.pmod(F.xxhash64("key"), F.lit(max(n, 1)))).otherwise(F.lit(0))) for name, n in total.items()])
    return ranked.withColumn("pack_no", F.when(F.col("size") == 0, empty).otherwise(pack_of("pack_name", "size", "rank")).cast("bigint"))
