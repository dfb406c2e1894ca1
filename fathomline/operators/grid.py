"""Counter readings at irregular times onto a regular time grid.

A source's stretches carry a cumulative counter: its value at the first sample
and after the last. Inside a series (a file) consecutive stretches are
differenced; a counter that falls back is a reset and loses nothing, one that
ran on over a hole lost its increment there. Each increment is spread over the
grid cells it overlaps, in proportion to the overlap; uncovered intervals of the
source mark the cells they reach. Work is split by (source, series) and by
(source, cell), so one source with a third of all rows is no single task.

Defined results: stretches with a null source, begin, rate or count are left
out; repeated rows count once (same source, series, first counter and begin: the
longest); zero-length gaps mark nothing; an empty table gives an empty grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counter_grid(df: DataFrame, gaps: DataFrame, key: str, series: Column, begin: Column, rate: Column, first: Column, count: Column, step_us: int = 60_000_000) -> DataFrame:
    """(key, cell_no, samples, lost, uncovered_us, status) for every cell from the first to the last reading.

    ``gaps`` has (key, gap_from_us, gap_to_us), the uncovered intervals between
    readings. status: 'empty' (no reading in the whole cell), 'partial' (a gap
    reaches into it), 'full'.
    """
    rows = df.select(F.col(key).alias("k"), series.alias("f"), begin.alias("b"), rate.alias("r"), F.coalesce(first, F.lit(0)).cast("bigint").alias("c0"), count.alias("n"))
    rows = rows.filter("k is not null and b is not null and r > 0 and n > 0")
    # one shuffle for both the repeats and the order within a series
    rows = rows.repartition("k", "f").groupBy("k", "f", "c0", "b").agg(F.max(F.struct("n", "r")).alias("m")).select("k", "f", "c0", "b", "m.n", "m.r")
    cell = lambda us: F.floor(us / F.lit(step_us)).cast("bigint")
    spacing = F.lit(1e6) / F.col("r")
    rows = rows.withColumn("t1", F.col("b") + F.rint(F.col("n") * spacing).cast("bigint")).withColumn("last", F.col("b") + F.rint((F.col("n") - 1) * spacing).cast("bigint"))
    w = Window.partitionBy("k", "f").orderBy("b", "c0")
    rows = rows.withColumn("p", F.lag(F.struct("t1", (F.col("c0") + F.col("n")).alias("c"))).over(w))

    covered = F.struct(F.col("b").alias("t0"), F.col("t1"), F.col("last"), F.col("n").cast("double").alias("inc"), F.lit(True).alias("seen"))
    jump = F.col("c0") - F.col("p.c")  # negative: the counter was reset
    hole = F.struct(F.col("p.t1").alias("t0"), F.col("b").alias("t1"), (F.col("b") - 1).alias("last"), jump.cast("double").alias("inc"), F.lit(False).alias("seen"))
    parts = F.array_compact(F.array(covered, F.when((jump > 0) & (F.col("b") > F.col("p.t1")), hole)))
    rows = rows.select("k", F.explode(parts).alias("x")).select("k", "x.*")
    rows = rows.withColumn("m", F.explode(F.sequence(cell(F.col("t0")), cell(F.col("last")))))
    # what lies beyond the last reading's cell belongs to that cell
    upper = F.when(F.col("m") == cell(F.col("last")), F.col("t1")).otherwise((F.col("m") + 1) * step_us)
    share = F.col("inc") * (upper - F.greatest(F.col("t0"), F.col("m") * step_us)) / (F.col("t1") - F.col("t0"))
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    counted = rows.select("k", "m", F.when(F.col("seen"), share).otherwise(zero).alias("s"), F.when(F.col("seen"), zero).otherwise(share).alias("l"), F.col("seen").cast("int").alias("r"), none.alias("u"))

    holes = gaps.select(F.col(key).alias("k"), F.col("gap_from_us").alias("f"), F.col("gap_to_us").alias("t"))
    holes = holes.withColumn("m", F.explode(F.sequence(cell(F.col("f")), cell(F.col("t") - 1))))
    reach = F.least("t", (F.col("m") + 1) * step_us) - F.greatest("f", F.col("m") * step_us)
    marked = holes.select("k", "m", zero.alias("s"), zero.alias("l"), F.lit(0).alias("r"), reach.alias("u"))

    out = counted.unionByName(marked).groupBy("k", "m").agg(F.sum("s").alias("samples"), F.sum("l").alias("lost"), F.sum("u").alias("uncovered_us"), F.max("r").alias("r"))
    status = F.when(F.col("r") == 0, "empty").when(F.col("uncovered_us") > 0, "partial").otherwise("full")
    return out.select(F.col("k").alias(key), F.col("m").alias("cell_no"), "samples", "lost", "uncovered_us", status.alias("status"))
