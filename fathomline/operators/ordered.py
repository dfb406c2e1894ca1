"""Ordered-group helpers that never put one whole group into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _edges(rows: DataFrame, keys: list[str], last: str, *cols: Column) -> DataFrame:
    """The last row of each (keys, shard) with ``cols``, under names that clash with nothing; one row a shard, without an aggregation."""
    return rows.filter(last).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_shard").alias("_s2"), *cols)


def _joined(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    cond = rows["_shard"].eqNullSafe(edges["_s2"])
    for i, k in enumerate(keys):
        cond = cond & rows[k].eqNullSafe(edges[f"_k{i}"])
    return rows.join(edges, cond, "left")


def sharded_lag(df: DataFrame, keys: list[str], shard: Column, order: list[str], values: list[str], into: str = "prev") -> DataFrame:
    """Previous row's ``values`` as a struct column ``into`` (null on a group's first row).

    ``shard`` must not decrease along ``order`` within ``keys``. Rows are lagged
    inside (keys, shard); only one summary row per shard crosses shards, so a
    key that owns a third of all rows is still spread over its shards.
    """
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order)
    rows = df.withColumn("_shard", shard).withColumn("_val", F.struct(*values))
    rows = rows.withColumns({"_lag": F.lag("_val").over(inside), "_end": F.lead(F.lit(True)).over(inside).isNull()})
    ks = [f"_k{i}" for i in range(len(keys))]
    ends = _edges(rows, keys, "_end", F.col("_val").alias("_last")).withColumn("_carry", F.lag("_last").over(Window.partitionBy(*ks).orderBy("_s2"))).drop("_last")
    out = _joined(rows, ends, keys).withColumn(into, F.coalesce("_lag", "_carry"))
    return out.drop("_shard", "_val", "_lag", "_end", "_s2", "_carry", *ks)


def sharded_runs(df: DataFrame, keys: list[str], shard: Column, order: list[str], values: list[str], breaks: Callable[[Column, Column], Column], into: str) -> DataFrame:
    """Number of the run a row lies in (0, 1, ... within ``keys``); ``breaks(value, value of the row before)`` tells where one begins.

    One pass: rows are numbered inside (keys, shard), one row a shard tells the
    others how many runs began before it and whether one begins with its first row.
    """
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order)
    rows = df.withColumn("_shard", shard).withColumn("_val", F.struct(*values))
    rows = rows.withColumns({"_lag": F.lag("_val").over(inside), "_end": F.lead(F.lit(True)).over(inside).isNull(), "_head": F.first("_val").over(inside)})
    begins = F.when(F.col("_lag").isNull(), 0).otherwise(breaks(F.col("_val"), F.col("_lag")).cast("int"))
    rows = rows.withColumn("_begins", begins).withColumn("_inner", F.sum("_begins").over(inside))
    ks = [f"_k{i}" for i in range(len(keys))]
    across = Window.partitionBy(*ks).orderBy("_s2")
    ends = _edges(rows, keys, "_end", "_head", F.col("_val").alias("_last"), F.col("_inner").alias("_within")).withColumn("_carry", F.lag("_last").over(across))
    ends = ends.withColumn("_first", F.when(F.col("_carry").isNull(), 0).otherwise(breaks(F.col("_head"), F.col("_carry")).cast("int")))
    ends = ends.withColumn("_before", F.sum(F.col("_within") + F.col("_first")).over(across) - F.col("_within")).select(*ks, "_s2", "_before")
    rows = rows.drop("_val", "_lag", "_end", "_head", "_begins")
    return _joined(rows, ends, keys).withColumn(into, F.col("_inner") + F.col("_before")).drop("_shard", "_inner", "_s2", "_before", *ks)
