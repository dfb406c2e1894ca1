"""Containers of samples: one row per (chunk, channel) with an array, or one per sample."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import stride, window_slice


def to_samples(traces: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """Long form: (keys, it, x).

    The outer form, as Spark otherwise infers a filter on the array's size and
    pushes it below Arrow kernels, where it would compute them once more.
    """
    return traces.select(*keys, F.posexplode_outer(samples).alias("it", "x")).filter("it is not null")


def to_traces(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Array form from the long one; samples are put in the order of ``it``."""
    packed = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("it", "x"))).alias("_s"))
    return packed.select(*keys, F.transform("_s", lambda s: s["x"]).alias("samples"))


def header(traces: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct scalar headers, with channel and sample counts."""
    return traces.groupBy(*cols).agg(F.count("*").alias("nx"), F.max(F.size("samples")).alias("n_samples"))


def time_axis(it: Column, t0_sec: Column, dt: Column) -> Column:
    return t0_sec + it * dt


def clock_axis(it: Column, begin_us: Column, dt: Column) -> Column:
    """Microseconds of each sample, steps rounded to the nanosecond."""
    return begin_us + F.floor(it * F.rint(dt * 1e9) / 1000).cast("bigint")


def truncate(traces: DataFrame, channels: tuple[int, int] | None, seconds: tuple[float, float] | None) -> DataFrame:
    """Channels [a, b) and times [s, t) of the trace's own seconds axis; sample bounds round halves to even."""
    out = traces
    if channels is not None:
        out = out.filter((F.col("channel") >= channels[0]) & (F.col("channel") < channels[1]))
    if seconds is not None:
        lo, hi = (F.rint((F.lit(s) - F.col("t0_sec")) / F.col("dt")).cast("int") for s in seconds)
        kept = F.greatest(lo, F.lit(0))
        out = out.withColumns({"samples": window_slice(F.col("samples"), lo, hi), "t0_sec": F.col("t0_sec") + kept * F.col("dt"), "begin_us": F.col("begin_us") + F.rint(kept * F.col("dt") * 1e6).cast("bigint")})
        out = out.withColumn("nt", F.size("samples"))
    return out


def select_channels(traces: DataFrame, wanted: list[int]) -> DataFrame:
    """Channels in the given order, repeats kept, numbered by ``position``; the list is part of the query, so it is small."""
    places: dict[int, list[int]] = {}
    for i, c in enumerate(wanted):
        places.setdefault(c, []).append(i)
    rows = traces.filter(F.col("channel").isin(*places)) if places else traces.limit(0)
    at = F.create_map(*[x for c, ps in places.items() for x in (F.lit(c), F.array(*map(F.lit, ps)))]) if places else F.create_map().cast("map<int,array<int>>")
    return rows.withColumn("position", F.explode(F.element_at(at, F.col("channel").cast("int"))))


def skip_channels(traces: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th channel, counted from the first of its chunk's numbering at 0."""
    return traces if step <= 1 else traces.filter(F.col("channel") % step == 0).withColumn("dx", F.col("dx") * step)


def skip_samples(traces: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th sample; the spacing grows with it."""
    if step <= 1:
        return traces
    out = traces.withColumns({"samples": stride(F.col("samples"), step), "dt": F.col("dt") * step, "fs": F.col("fs") / step})
    return out.withColumn("nt", F.size("samples"))


TIME_BLOCK = 2048


def subtract_common_mode(traces: DataFrame, chunk: str, ch_min: int | None = None, ch_max: int | None = None, keys: list[str] = ["channel"], block: int = TIME_BLOCK) -> DataFrame:  # noqa: B006 - never changed
    """Less the median over channels [ch_min, ch_max) at each sample of a chunk, from every channel: (chunk, keys, block, samples).

    One shuffle, of arrays: a block of time of a chunk's channels is one matrix, so a
    task holds ``block`` samples of as many channels as the instrument has.
    Where no channel of the band has a value, the result is null.
    """
    n = F.size("samples")
    rows = traces.select(chunk, *keys, "samples", F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")))).alias("block"))
    rows = rows.select(chunk, *keys, "block", F.transform(F.slice("samples", F.col("block") * block + 1, block), lambda x: x.cast("double")).alias("samples"))

    def less_median(part: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, part["samples"]))
        m = np.full((len(part), width), np.nan)
        for i, x in enumerate(part["samples"]):
            m[i, : len(x)] = np.asarray(x, float)
        ch = part["channel"].to_numpy()
        band = np.ones(len(part), bool)
        if ch_min is not None:
            band &= ch >= ch_min
        if ch_max is not None:
            band &= ch < ch_max
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # columns without a value
            out = m - np.nanmedian(m[band], axis=0) if band.any() else np.full_like(m, np.nan)
        return part.assign(samples=[[None if np.isnan(v) else v for v in y[: len(x)]] if np.isnan(y[: len(x)]).any() else y[: len(x)] for x, y in zip(part["samples"], out, strict=True)])

    return rows.groupBy(chunk, "block").applyInPandas(less_median, rows.schema)


def block_samples(blocks: DataFrame, keys: list[str], block: int = TIME_BLOCK) -> DataFrame:
    """Long form (keys, it, x) of blocks of time."""
    out = blocks.select(*keys, "block", F.posexplode("samples").alias("_i", "x"))
    return out.select(*keys, (F.col("block") * block + F.col("_i")).cast("int").alias("it"), "x")


def joined_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Array form (keys, samples) of blocks of time."""
    whole = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "samples"))).alias("_s"))
    return whole.select(*keys, F.flatten(F.col("_s.samples")).alias("samples"))


ZEROS_AT_ONCE = 65_536


def layout(traces: DataFrame, keys: list[str], begin_us: str, rate: str, fill: bool = True) -> DataFrame:
    """Blocks of a channel with their length _n, the missing samples before them _gap (0 without ``fill``), and their place _at in the channel's one series."""
    w = Window.partitionBy(*keys).orderBy(begin_us)
    rows = traces.withColumn("_n", F.size("samples")).filter("_n > 0")
    step = F.lit(1e6) / F.col(rate)
    stop = F.col(begin_us) + F.col("_n") * step
    gap = F.coalesce(F.greatest(F.rint((F.col(begin_us) - F.lag(stop).over(w)) / step), F.lit(0)), F.lit(0)).cast("bigint")
    rows = rows.withColumn("_gap", gap if fill else F.lit(0).cast("bigint"))
    total = F.sum(F.col("_gap") + F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_at", total - F.col("_n"))


def stitched(traces: DataFrame, keys: list[str], begin_us: str, rate: str, fill: bool = True) -> DataFrame:
    """Blocks of a channel in time order as one series: (keys, it, x); missing samples between blocks are zeros if ``fill``.

    A block that overlaps the one before follows it as it is. Repeated blocks must be gone before.
    """
    return placed(layout(traces, keys, begin_us, rate, fill), keys, "_at", "_gap")


def placed(blocks: DataFrame, keys: list[str], at: str, zeros: str | None) -> DataFrame:
    """(keys, it, x) of blocks of samples that begin at index ``at``, with ``zeros`` zeros before each (none where the column isn't named).

    Zeros are made a stretch at a time, never as one array.
    """
    held = blocks.select(*keys, F.col(at).alias("_at"), F.posexplode("samples").alias("_i", "x")).select(*keys, (F.col("_at") + F.col("_i")).alias("it"), F.col("x").cast("double").alias("x"))
    if zeros is None:
        return held
    gaps = blocks.filter(F.col(zeros) > 0).select(*keys, (F.col(at) - F.col(zeros)).alias("_from"), F.col(at).alias("_to"))
    gaps = gaps.withColumn("_lo", F.explode(F.sequence("_from", F.col("_to") - 1, F.lit(ZEROS_AT_ONCE).cast("bigint"))))
    gaps = gaps.select(*keys, F.explode(F.sequence("_lo", F.least(F.col("_lo") + ZEROS_AT_ONCE, F.col("_to")) - 1)).alias("it"), F.lit(0.0).alias("x"))
    return held.unionByName(gaps)
