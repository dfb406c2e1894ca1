"""Event windows cut out of a catalog: what to read for each event, and its status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import interval_join


def extract_plan(events: DataFrame, catalog: DataFrame, before_us: int, after_us: int, bucket_us: int = 3_600_000_000, on: list[str] | None = None) -> DataFrame:
    """(event_id, file, offset, n_samples, event_index): rows of the catalog in [t - before, t + after) of each event.

    ``events`` has (event_id, event_us); the event's index counts from the first
    sample read. Halves round to even.
    """
    ev = events.withColumns({"window_begin": F.col("event_us") - before_us, "window_end": F.col("event_us") + after_us})
    rows = interval_join(ev, catalog, ("window_begin", "window_end"), ("begin_us", "end_us"), bucket_us, on)
    dt = F.lit(1e6) / F.col("fs")
    lo = F.greatest("window_begin", "begin_us")
    hi = F.least(F.col("window_end").cast("double"), F.col("begin_us") + F.col("nt") * dt)
    rows = rows.withColumns({"offset": F.rint((lo - F.col("begin_us")) / dt).cast("bigint"), "n_samples": F.rint((hi - lo) / dt).cast("bigint"), "event_index": F.rint((F.col("event_us") - lo) / dt).cast("bigint")})
    return rows.filter("n_samples > 0").select(*(on or []), "event_id", "file", "offset", "n_samples", "event_index")


def cut_samples(plan: DataFrame, traces: DataFrame, keys: list[str] = ["file"]) -> DataFrame:  # noqa: B006 - never changed
    """(event_id, channel, begin_us, fs, samples): the pieces of each event put together, one row a channel.

    ``plan`` has a row a piece (event_id, keys, fs, at_us its first sample's time,
    first and n_samples in its trace), ``traces`` (keys, channel, samples). Missing
    samples between pieces are zeros; their number is bounded by the event's
    window. Events whose pieces differ in rate, or are not all there, are left out.
    """
    dt = F.lit(1e6) / F.col("fs")
    w = Window.partitionBy("event_id").orderBy("at_us", *keys, "first")
    gap = F.rint((F.col("at_us") - F.lag(F.col("at_us") + F.col("n_samples") * dt).over(w)) / dt).cast("int")
    of_event = Window.partitionBy("event_id")
    plan = plan.withColumns({"_zeros": F.when(gap > 1, gap).otherwise(0), "_n": F.count("*").over(of_event), "begin_us": F.min("at_us").over(of_event), "_even": F.min("fs").over(of_event) == F.max("fs").over(of_event)})
    parts = plan.filter("_even").join(traces.select(*keys, "channel", F.col("samples").alias("_all")), keys)
    x = F.slice("_all", (F.col("first") + 1).cast("int"), F.col("n_samples").cast("int"))
    parts = parts.withColumn("_x", F.concat(F.array_repeat(F.lit(0.0).cast("float"), F.col("_zeros")), x))
    whole = parts.groupBy("event_id", "channel", "begin_us", "fs", "_n").agg(F.array_sort(F.collect_list(F.struct("at_us", *keys, "first", "_x"))).alias("_parts")).filter(F.size("_parts") == F.col("_n"))
    return whole.select("event_id", "channel", "begin_us", "fs", F.flatten(F.col("_parts._x")).alias("samples"))


def extract_status(events: DataFrame, plan: DataFrame, done: DataFrame) -> DataFrame:
    """(event_id, status): 'skip' if its output is there, 'extract' if there is something to read, else 'fail'."""
    ids = plan.select("event_id").distinct().withColumn("_plan", F.lit(True))
    there = done.select("event_id").distinct().withColumn("_done", F.lit(True))
    rows = events.join(ids, "event_id", "left").join(there, "event_id", "left")
    return rows.select("event_id", F.when(F.col("_done"), "skip").when(F.col("_plan"), "extract").otherwise("fail").alias("status"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))
