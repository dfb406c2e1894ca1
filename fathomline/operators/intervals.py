"""Coverage of overlapping, nested and gapped time intervals.

Two-level merge. Every interval is clipped into fixed time shards; each
(entity, shard) is merged on its own by a running latest end; one summary row
per shard is then stitched inside blocks of shards, and one summary row per
block across the entity. An entity that owns a third of all rows is spread over
its shards, and what crosses shards is a row each.

Defined results: intervals with a null entity, a null end or an end before
their begin are no coverage; a null tolerance counts as 0; repeated rows change
nothing; of rows that tie for the latest end the larger tolerance holds; an
empty table gives an empty result. Columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import sharded_lag

SHARD_US = 3_600_000_000
BLOCK = 512


def _levels(df: DataFrame, key: Column, begin: Column, end: Column, tolerance: Column, shard_us: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(gaps, blocks): rows (k, f, t), in which each gap has been found once; and per (key, block) fb, last(e, tol)."""
    rows = df.select(key.alias("k"), begin.cast("bigint").alias("b"), end.cast("bigint").alias("e"), F.coalesce(tolerance.cast("double"), F.lit(0.0)).alias("tol"))
    rows = rows.filter("k is not null and b is not null and e >= b")
    div = lambda c: F.floor(F.col(c) / F.lit(shard_us)).cast("bigint")
    rows = rows.withColumn("s", F.explode(F.sequence(div("b"), div("e"))))
    rows = rows.select("k", "s", F.greatest("b", F.col("s") * shard_us).alias("b"), F.least("e", (F.col("s") + 1) * shard_us).alias("e"), "tol")
    # summaries are combined on the map side; the gaps inside shards need the rows themselves
    summary = (F.min("b").alias("fb"), F.max(F.struct("e", "tol")).alias("last"))
    shards = rows.groupBy("k", "s").agg(*summary).withColumn("bl", F.floor(F.col("s") / F.lit(block)).cast("bigint"))
    blocks = shards.groupBy("k", "bl").agg(F.min("fb").alias("fb"), F.max("last").alias("last"))

    so_far = Window.partitionBy("k", "s").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    inside = _between(rows.withColumn("p", F.max(F.struct("e", "tol")).over(so_far)), "b")
    shards = shards.withColumn("p", F.lag("last").over(Window.partitionBy("k", "bl").orderBy("s")))
    across = _between(shards, "fb")
    ends = _between(blocks.withColumn("p", F.lag("last").over(Window.partitionBy("k").orderBy("bl"))), "fb")
    return inside.unionByName(across).unionByName(ends), blocks


def _between(df: DataFrame, begin: str) -> DataFrame:
    """The gap between a row's begin and the latest end ``p`` before it, where there is one."""
    return df.filter(F.col(begin) - F.col("p.e") > F.col("p.tol")).select("k", F.col("p.e").alias("f"), F.col(begin).alias("t"))


def coverage_gaps(df: DataFrame, key: str, begin: Column, end: Column, tolerance: Column, shard_us: int = SHARD_US, block: int = BLOCK) -> DataFrame:
    """Gaps per entity: (key, gap_from_us, gap_to_us), wider than the tolerance of the row with the latest end."""
    gaps, _ = _levels(df, F.col(key), begin, end, tolerance, shard_us, block)
    return gaps.select(F.col("k").alias(key), F.col("f").alias("gap_from_us"), F.col("t").alias("gap_to_us"))


def coverage_periods(df: DataFrame, key: str, begin: Column, end: Column, tolerance: Column, shard_us: int = SHARD_US, block: int = BLOCK) -> DataFrame:
    """Continuous periods per entity: (key, period_from_us, period_to_us).

    A period begins with the entity or after a gap, and ends with a gap or the
    entity; each end is paired with the begin before it, shard by shard.
    """
    gaps, blocks = _levels(df, F.col(key), begin, end, tolerance, shard_us, block)
    whole = blocks.groupBy("k").agg(F.max("last")["e"].alias("f"), F.min("fb").alias("t"))
    mark = lambda t, o: F.struct(F.col(t).alias("t"), F.lit(o).alias("open"))
    marks = gaps.unionByName(whole).select("k", F.inline(F.array(mark("t", 1), mark("f", 0))))
    pairs = sharded_lag(marks.withColumn("o", -F.col("open")), ["k"], F.floor(F.col("t") / F.lit(shard_us * block)).cast("bigint"), ["t", "o"], ["t", "open"])
    return pairs.filter("open = 0 and prev.open = 1").select(F.col("k").alias(key), F.col("prev.t").alias("period_from_us"), F.col("t").alias("period_to_us"))
