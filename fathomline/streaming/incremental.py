"""Streams of catalog rows: incremental catalogs, ready windows, running coverage."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from ..operators.catalog import keep_last


def ingest(stream: DataFrame, target: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Appends each batch's rows, one per (file, first_sample), to the catalog at ``target``.

    A row the catalog has is written again only by its batch number, so a batch
    that is run twice leaves the same rows; ``current`` reads the last of each.
    Call ``awaitTermination`` on the query; it ends once all that is there is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = keep_last(batch, ["file", "first_sample"], order).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(str(PurePosixPath(target) / f"batch={number}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The catalog as it is: the last row of each (file, first_sample)."""
    rows = spark.read.parquet(target)
    return keep_last(rows, ["file", "first_sample"], ["batch"]).drop("batch")


def unseen(spark: SparkSession, listed: DataFrame, target: str) -> DataFrame:
    """Listed files that no batch has brought yet."""
    try:
        known = spark.read.parquet(target).select("file").distinct()
    except AnalysisException:
        return listed
    return listed.join(known, "file", "left_anti")


def ready_windows(stream: DataFrame, key: str, length_us: int) -> DataFrame:
    """Windows anchored on row begins, each given out once its end is at or before a begin that came.

    (key, window_begin, window_end). Rows of a batch may come in any order; a
    row before a window already given out is late and dropped. State per key:
    the begins that wait, which are those of the window not yet ready.
    """
    kind = stream.schema[key].dataType
    out = StructType([StructField(key, kind), StructField("window_begin", LongType()), StructField("window_end", LongType())])
    kept = StructType([StructField("waiting", ArrayType(LongType())), StructField("done", LongType())])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, done = state.get if state.exists else ([], -(2**62))
        begins = sorted({*waiting, *(int(b) for f in frames for b in f["begin_us"])})
        begins = [b for b in begins if b >= done]
        found = []
        while begins and begins[0] + length_us <= begins[-1]:
            done = begins[0] + length_us
            found.append((group[0], begins[0], done))
            begins = [b for b in begins if b >= done]
        state.update((begins, done))
        yield pd.DataFrame(found, columns=[key, "window_begin", "window_end"])

    return stream.select(key, "begin_us").groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, key: str, gap_factor: float = 1.5) -> DataFrame:
    """Segments as sessions, each given out once the row that ends it has come: (key, begin_us, end_us, n_rows).

    A session ends where fs or nx change, or the step to the next row differs
    from one spacing by more than ``gap_factor`` spacings. Rows of a batch may come
    in any order; a row before the open session's last begin is late and dropped.
    State per key: the open session.
    """
    kind = stream.schema[key].dataType
    out = StructType([StructField(key, kind), StructField("begin_us", LongType()), StructField("end_us", LongType()), StructField("n_rows", LongType())])
    kept = StructType([StructField(c, LongType()) for c in ("begin_us", "end_us", "last_us", "nx", "n_rows")] + [StructField("fs", DoubleType())])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = list(state.get) if state.exists else None
        found = []
        for b, e, nx, fs in sorted((int(b), int(e), int(n), float(f)) for x in frames for b, e, n, f in zip(x["begin_us"], x["end_us"], x["nx"], x["fs"], strict=True)):
            if at and b < at[2]:
                continue
            spacing = 1e6 / at[5] if at else 0.0
            if at and fs == at[5] and nx == at[3] and abs(b - at[1] - spacing) <= (gap_factor + 1e-5) * spacing:
                at[1:3], at[4] = [e, b], at[4] + 1
                continue
            if at:
                found.append((group[0], at[0], at[1], at[4]))
            at = [b, e, b, nx, 1, fs]
        if at:
            state.update(tuple(at))
        yield pd.DataFrame(found, columns=[f.name for f in out])

    return stream.select(key, "begin_us", "end_us", "nx", "fs").groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def coverage_by_window(stream: DataFrame, key: str, time: str, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Rows and samples that begin in each window of each key; rows later than ``late`` are dropped."""
    w = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(key, w.alias("window")).agg(F.count("*").alias("n_rows"), F.sum("nt").alias("n_samples"))
