"""Downsampling of raw recordings into processed ones, window by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import row_kernel
from ..functions.filters import filtered
from ..functions.scalars import processed_name
from ..functions.series import unwrap
from ..operators.joins import interval_join


def ratio_for(fs: float, f_max: float) -> int:
    """Whole downsampling ratio that keeps ``f_max`` at 0.4 of the new rate; 1 if no corner is given."""
    return max(1, int(fs / (2.5 * f_max))) if f_max > 0 else 1


def desample(samples: Column, fs: float, f_max: float = 0.4, order: int = 14, wrapped: bool = False) -> Column:
    """Unwrapped if counts roll over, low-passed at ``f_max`` without phase shift, every ratio-th sample."""
    ratio = ratio_for(fs, f_max)
    x = unwrap()(samples) if wrapped else samples
    return row_kernel(lambda m: (filtered(m, 0.0, f_max / fs, order, True) if f_max > 0 else m)[:, ::ratio])(x)


def trim_bounds(n_out: Column, first_us: Column, dt_out_us: Column, target_us: Column, after_us: Column) -> tuple[Column, Column]:
    """Slice [left, right) of the decimated axis that covers the target rows only.

    left is the sample nearest to the first target row (0 without a padding row
    before, target_us null); right follows the sample nearest to one output
    sample before the padding row after (all without one, after_us null). Ties
    go to the earlier sample.
    """
    near = lambda us: F.greatest(F.least(F.ceil((us - first_us) / dt_out_us - 0.5), n_out - 1), F.lit(0)).cast("int")
    left = F.when(target_us.isNull(), 0).otherwise(near(target_us))
    right = F.when(after_us.isNull(), n_out).otherwise(near(after_us - dt_out_us) + 1)
    return left, right


def pending(windows: DataFrame, done: DataFrame, system: Column, dated: bool = False) -> DataFrame:
    """Windows whose processed file isn't there yet; named by the window's own begin."""
    named = windows.withColumn("file", processed_name(system, F.col("window_begin"), dated))
    return named.join(done.select("file"), "file", "left_anti")


def desample_windows(rows: DataFrame, windows: DataFrame, key: str, fs: float, f_max: float = 0.4, order: int = 14, wrapped: bool = False) -> DataFrame:
    """Processed channels of each window: (key, segment_id, window_begin, channel, begin_us, fs_out, samples).

    ``rows`` are a catalog's segmented rows with their channels' samples: (key,
    segment_id, file, begin_us, end_us, channel, samples). A window takes the
    rows that meet it and one more of the segment on each side, so that the
    filter's edges fall on padding; a channel's rows are put together, filtered,
    decimated and cut to the target rows. Rows meet their windows by time
    buckets, never all windows of a segment.
    """
    ratio = ratio_for(fs, f_max)
    dt_out = F.lit(ratio * 1e6 / fs)
    # a row beside the window's own ones ends or begins within one row's length of it
    longest = rows.agg(F.max(F.col("end_us") - F.col("begin_us"))).first()[0] or 0
    margin = longest + int(5e6 / fs)
    near = windows.select(key, "segment_id", "window_begin", "window_end", (F.col("window_begin") - margin).alias("_from"), (F.col("window_end") + margin).alias("_until"))
    parts = interval_join(rows, near, ("begin_us", "end_us"), ("_from", "_until"), max(longest, 1_000_000), [key, "segment_id"], closed=True).drop("_from", "_until")
    w = Window.partitionBy(key, "segment_id", "window_begin", "channel").orderBy("begin_us")
    hit = (F.col("begin_us") < F.col("window_end")) & (F.col("end_us") > F.col("window_begin"))
    parts = parts.withColumn("_hit", hit).withColumns({"_next": F.lead("_hit").over(w), "_prev": F.lag("_hit").over(w)})
    parts = parts.withColumn("_role", F.when(F.col("_hit"), 1).when(F.col("_next"), 0).when(F.col("_prev"), 2)).filter("_role is not null")
    whole = parts.groupBy(key, "segment_id", "window_begin", "channel").agg(
        F.array_sort(F.collect_list(F.struct("begin_us", "samples"))).alias("_rows"),
        F.min(F.when(F.col("_role") == 1, F.col("begin_us"))).alias("_target"),
        F.min(F.when(F.col("_role") == 2, F.col("begin_us"))).alias("_after"),
        F.max(F.when(F.col("_role") == 0, F.lit(True))).alias("_padded"),
    )
    joined = F.flatten(F.transform("_rows", lambda r: F.transform(r["samples"], lambda v: v.cast("double"))))
    out = whole.select(key, "segment_id", "window_begin", "channel", F.col("_rows")[0]["begin_us"].alias("_first"), "_target", "_after", "_padded", joined.alias("_x"))
    out = out.withColumn("_y", desample(F.col("_x"), fs, f_max, order, wrapped))
    left, right = trim_bounds(F.size("_y"), F.col("_first"), dt_out, F.when(F.col("_padded"), F.col("_target")), F.col("_after"))
    out = out.withColumns({"_l": left, "_r": right})
    return out.select(key, "segment_id", "window_begin", "channel", (F.col("_first") + F.rint(F.col("_l") * dt_out)).cast("bigint").alias("begin_us"), F.lit(fs / ratio).alias("fs_out"), F.slice("_y", F.col("_l") + 1, F.greatest(F.col("_r") - F.col("_l"), F.lit(0))).alias("samples"))
