"""Ambient noise: preparation, pair correlations, stacks over segments and datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.filters import bandpass
from ..functions.spectral import xcorr
from ..operators.joins import interval_join
from ..operators.traces import joined_blocks, subtract_common_mode


def prepare(traces: DataFrame, keys: list[str], chunk: str, dt: float, band: tuple[float, float] | None = None, order: int = 4, alpha: float = 0.1, step: int = 1, common_mode: bool = True, detrended: bool = True, window_sec: float | None = None, normalise: bool = True) -> DataFrame:
    """Derivative, detrend, taper and band-pass if a band is given, stride, common mode, amplitude normalisation.

    Everything but the common mode stays in a channel's array. The common mode
    shuffles blocks of the arrays by (chunk, time), and once more to put a
    channel's blocks together.
    """
    x = S.gradient(F.col("samples"), F.lit(dt))
    out = traces.select(*keys, x.alias("samples"))
    if detrended:
        out = out.withColumn("samples", S.detrend(F.col("samples")))
    if band is not None:
        out = out.withColumn("samples", bandpass(band[0], band[1], dt, order, step=step)(S.taper(F.col("samples"), alpha)))
    else:
        out = out.withColumn("samples", S.stride(F.col("samples"), step))
    if common_mode:
        out = joined_blocks(subtract_common_mode(out, chunk, keys=[k for k in keys if k != chunk]), keys)
    if not normalise:
        return out
    if not window_sec:
        return out.withColumn("samples", S.one_bit(F.col("samples")))
    return out.withColumn("samples", S.running_abs_mean(max(1, round(window_sec / (dt * step))))(F.col("samples")))


def pair_traces(traces: DataFrame, pairs: DataFrame, chunk: str) -> DataFrame:
    """(chunk, ch1, ch2, a, b): both channels' samples of each pair (ch1, ch2), by two equi-joins."""
    a = traces.select(chunk, F.col("channel").alias("ch1"), F.col("samples").alias("a"))
    b = traces.select(F.col(chunk).alias("_c"), F.col("channel").alias("_ch"), F.col("samples").alias("b"))
    keyed = pairs.join(a, ["ch1"] + ([chunk] if chunk in pairs.columns else []))
    return keyed.join(b, (keyed["ch2"] == b["_ch"]) & (keyed[chunk] == b["_c"])).drop("_c", "_ch")


def segmented(paired: DataFrame, n: int) -> DataFrame:
    """Whole segments of n samples of both sides; what is left over at the end goes."""
    count = F.floor(F.least(F.size("a"), F.size("b")) / n).cast("int")
    rows = paired.withColumn("segment", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    return rows.withColumns({c: F.slice(c, F.col("segment") * n + 1, n) for c in ("a", "b")})


def stack(paired: DataFrame, keys: list[str], n: int, max_lag: int, **options) -> DataFrame:
    """Mean correlation over a pair's segments: (keys, ch1, ch2, nseg, cc)."""
    rows = segmented(paired, n).withColumn("cc", xcorr(F.col("a"), F.col("b"), max_lag, **options))
    return array_mean(rows, [*keys, "ch1", "ch2"], "cc", F.lit(1), "nseg")


def array_mean(rows: DataFrame, keys: list[str], values: str, weight, into: str) -> DataFrame:
    """Weighted mean of equal-length arrays, element by element, combined on the map side by (keys, element)."""
    flat = rows.select(*keys, weight.cast("bigint").alias("_w"), F.posexplode(values).alias("_i", "_v"))
    per = flat.groupBy(*keys, "_i").agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n"))
    out = per.groupBy(*keys).agg(F.max("_n").alias(into), F.array_sort(F.collect_list(F.struct("_i", (F.col("_s") / F.col("_n")).alias("_v")))).alias("_a"))
    return out.select(*keys, into, F.transform("_a", lambda e: e["_v"]).alias(values))


def dataset_stack(stacks: DataFrame) -> DataFrame:
    """Stacks of many chunks as one, weighted by their numbers of segments: (ch1, ch2, nseg, cc)."""
    return array_mean(stacks.select("ch1", "ch2", F.col("nseg").alias("_k"), "cc"), ["ch1", "ch2"], "cc", F.col("_k"), "nseg")


def stacking_windows(segmented: DataFrame, key: str, window_us: int, begin_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """(key, segment_id, chunk, window_begin, window_end): windows of one length that start anew with each segment, within [begin_us, end_us)."""
    spans = segmented.groupBy(key, "segment_id").agg(F.min("begin_us").alias("_b"), (F.max("end_us") + F.rint(F.lit(1e6) / F.max("fs")).cast("bigint")).alias("_e"))
    lo = F.greatest("_b", F.lit(begin_us).cast("bigint")) if begin_us is not None else F.col("_b")
    hi = F.least("_e", F.lit(end_us).cast("bigint")) if end_us is not None else F.col("_e")
    spans = spans.select(key, "segment_id", lo.alias("_b"), hi.alias("_e")).filter("_e > _b")
    spans = spans.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil((F.col("_e") - F.col("_b")) / F.lit(window_us)).cast("bigint") - 1)))
    begin = F.col("_b") + F.col("_k") * window_us
    return spans.select(key, "segment_id", F.concat_ws(":", key, "segment_id", "_k").alias("chunk"), begin.alias("window_begin"), F.least(begin + window_us, "_e").alias("window_end"))


def read_chunks(segmented: DataFrame, windows: DataFrame, key: str, reader: Callable[[DataFrame], DataFrame], window_us: int) -> DataFrame:
    """(chunk, channel, samples) of each window, read from its files; ``reader`` as in ``recordings.read_range``. Rows of a segment follow each other as they are."""
    rows = segmented.withColumn("_stop", (F.col("begin_us") + F.col("nt") * 1e6 / F.col("fs")).cast("bigint"))
    parts = interval_join(rows, windows, ("begin_us", "_stop"), ("window_begin", "window_end"), window_us, [key, "segment_id"])
    dt = F.lit(1e6) / F.col("fs")
    lo, hi = F.greatest("begin_us", "window_begin"), F.least(F.col("begin_us") + F.col("nt") * dt, F.col("window_end").cast("double"))
    parts = parts.select("chunk", "file", "begin_us", (F.col("first_sample") + F.rint((lo - F.col("begin_us")) / dt).cast("bigint")).alias("first_sample"), F.rint((hi - lo) / dt).cast("bigint").alias("nt")).filter("nt > 0")
    parts = parts.withColumn("slice", F.concat_ws(":", "first_sample", "nt"))
    traces = reader(parts.select("file", "first_sample", "nt").distinct()).select("file", "slice", "channel", "samples")
    whole = parts.join(traces, ["file", "slice"]).groupBy("chunk", "channel").agg(F.array_sort(F.collect_list(F.struct("begin_us", "first_sample", "samples"))).alias("_p"))
    return whole.select("chunk", "channel", F.flatten(F.col("_p.samples")).alias("samples"))


def catalog_stack(segmented: DataFrame, key: str, pairs: DataFrame, reader: Callable[[DataFrame], DataFrame], dt: float, window_us: int, n: int, max_lag: int, begin_us: int | None = None, end_us: int | None = None, prep: dict | None = None, **options) -> DataFrame:
    """Mean correlation of channel pairs (ch1, ch2) over a whole catalog: (ch1, ch2, nseg, cc).

    Windows start anew with each segment, so none spans a gap; each is read,
    prepared by ``prepare`` with ``prep``, cut into pieces of ``n`` samples and
    correlated; the stacks of all windows are weighted by their pieces.
    """
    chunks = read_chunks(segmented, stacking_windows(segmented, key, window_us, begin_us, end_us), key, reader, window_us)
    ready = prepare(chunks, ["chunk", "channel"], "chunk", dt, **(prep or {}))
    return dataset_stack(stack(pair_traces(ready, pairs, "chunk"), ["chunk"], n, max_lag, **options))


def lag_table(stacks: DataFrame, keys: list[str], max_lag: int, fs: float) -> DataFrame:
    """Long form: (keys, lag, lag_s, cc)."""
    return stacks.select(*keys, F.posexplode("cc").alias("_i", "cc")).select(*keys, (F.col("_i") - max_lag).alias("lag"), ((F.col("_i") - max_lag) / F.lit(fs)).alias("lag_s"), "cc")


