"""Catalog of recordings: segments, windows, read plans, upkeep.

A catalog row is one readable piece: begin_us and end_us (last sample,
inclusive) in microseconds, fs, nt, nx, file, first_sample. Query windows are
half-open [begin, end); a row meets one if it begins before the window's end and
ends after its begin. Sample indices round halves to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .ordered import sharded_lag, sharded_runs

DAY_US = 86_400_000_000
RELATIVE = 1e-5  # relative part of the tolerance when spacings are compared
ORDER = ["begin_us", "file", "first_sample"]  # add a row id where rows may tie in all three
COLUMNS = ["file", "begin_us", "end_us", "fs", "nt", "nx", "dx", "gauge_length_m", "first_sample"]


def with_columns(df: DataFrame, *others: str) -> DataFrame:
    """The catalog's columns, missing ones as null and first_sample as 0 by default, and those named."""
    have = set(df.columns)
    blank = {"file": "string", "begin_us": "bigint", "end_us": "bigint", "nt": "bigint", "nx": "int", "first_sample": "bigint"}
    return df.select(*[F.col(c) if c in have else F.lit(0 if c == "first_sample" else None).cast(blank.get(c, "double")).alias(c) for c in COLUMNS], *others)


def _differs(now: Column, was: Column) -> Column:
    """Whether a number differs from another; a null or NaN differs from everything."""
    a, b = now.cast("double"), was.cast("double")
    return F.coalesce((a != b) | F.isnan(a) | F.isnan(b), F.lit(True))


def segments(df: DataFrame, key: str, gap_factor: float = 1.5, order: list[str] = ORDER) -> DataFrame:
    """Adds segment_id (0, 1, ... within ``key``): contiguous rows of equal parameters.

    A new segment begins where fs, nx or the file's repetition breaks the run,
    or where the step from the last sample to the next differs from one spacing
    by more than ``gap_factor`` spacings (1e-5 of a spacing more).
    """

    def breaks(now: Column, was: Column) -> Column:
        spacing = F.when(was["fs"] > 0, 1 / was["fs"]).otherwise(F.lit(0.0))
        step = (now["begin_us"] - was["end_us"]) / 1e6
        contiguous = F.abs(step - spacing) <= gap_factor * spacing + RELATIVE * F.abs(spacing)
        same_file = F.coalesce(now["file"] == was["file"], F.lit(False))
        return _differs(now["fs"], was["fs"]) | _differs(now["nx"], was["nx"]) | same_file | ~F.coalesce(contiguous, F.lit(False))

    day = F.floor(F.col("begin_us") / F.lit(DAY_US)).cast("bigint")
    return sharded_runs(df, [key], day, order, ["begin_us", "end_us", "fs", "nx", "file"], breaks, "segment_id")


def segment_table(segmented: DataFrame, key: str) -> DataFrame:
    """One row per segment: begin, end and number of rows."""
    return segmented.groupBy(key, "segment_id").agg(F.min("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_rows"))


def segment_gaps(table: DataFrame, key: str) -> DataFrame:
    """Gaps between segments in their order, where the next begins after the one before ends."""
    day = F.floor(F.col("begin_us") / F.lit(DAY_US)).cast("bigint")
    out = sharded_lag(table, [key], day, ["begin_us", "segment_id"], ["segment_id", "end_us"]).filter(F.col("begin_us") > F.col("prev.end_us"))
    return out.select(key, F.col("prev.segment_id").alias("segment_id"), F.col("prev.end_us").alias("gap_from_us"), F.col("begin_us").alias("gap_to_us"))


def meets(begin: Column, end: Column) -> Column:
    """Whether a row meets the window [begin, end)."""
    return (F.col("begin_us") < end) & (F.col("end_us") > begin)


def select_window(segmented: DataFrame, windows: DataFrame, key: str, pad: bool = True, order: list[str] = ORDER) -> DataFrame:
    """Rows that meet each key's window, and with ``pad`` the row before and after them in the same segment.

    ``windows`` has (key, window_begin, window_end). role: 'target', 'before' or 'after'.
    """
    rows = segmented.join(windows, key)
    w = Window.partitionBy(key, "segment_id").orderBy(*order)
    hit = meets(F.col("window_begin"), F.col("window_end"))
    rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumns({"_next": F.lead("_hit").over(w), "_prev": F.lag("_hit").over(w)})
    role = F.when(F.col("_hit"), "target").when(F.col("_next"), "before").when(F.col("_prev"), "after")
    rows = rows.withColumn("role", role).drop("_hit", "_next", "_prev").filter("role is not null")
    return rows if pad else rows.filter("role = 'target'")


def read_plan(segmented: DataFrame, windows: DataFrame, key: str, order: list[str] = ORDER) -> DataFrame:
    """What to read of each row for its key's window: (sample_from, n_samples) in the file, and the zeros before it.

    Between segments of a window the missing samples are zeros; inside a segment
    rows follow each other as they are.
    """
    rows = segmented.join(windows, key).filter(meets(F.col("window_begin"), F.col("window_end")))
    dt = F.lit(1e6) / F.col("fs")
    stop = F.col("begin_us") + F.col("nt") * dt
    lo, hi = F.greatest("begin_us", "window_begin"), F.least(stop, F.col("window_end").cast("double"))
    rows = rows.withColumns({"_lo": lo, "_offset": F.rint((lo - F.col("begin_us")) / dt).cast("bigint"), "n_samples": F.rint((hi - lo) / dt).cast("bigint")}).filter("n_samples > 0")
    rows = rows.withColumn("_stop", F.col("_lo") + F.col("n_samples") * dt)
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.rint((F.col("_lo") - F.lag("_stop").over(w)) / dt).cast("bigint")
    fresh = F.lag("segment_id").over(w) != F.col("segment_id")
    rows = rows.withColumn("zeros_before", F.when(F.coalesce(fresh, F.lit(False)), F.greatest(gap, F.lit(0))).otherwise(F.lit(0)))
    return rows.withColumn("sample_from", F.col("first_sample") + F.col("_offset")).drop("_lo", "_offset", "_stop")


def append(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union in which of rows with equal ``keys`` the last by ``order`` stays; rows of ``new`` come last."""
    rows = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return keep_last(rows, keys, ["_batch", *order]).drop("_batch")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by ``order`` of each key, in one aggregation with map-side combining."""
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_r"))
    return kept.select(*keys, "_r.*").select(*df.columns)


def unknown_files(listed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listed files that the catalog doesn't have."""
    return listed.join(catalog.select("file"), "file", "left_anti")


def after_cutoff(raw: DataFrame, done: DataFrame, key: str, done_until: Column) -> DataFrame:
    """Raw rows that begin after the last processed time of their key; all rows where nothing is processed."""
    cut = done.groupBy(key).agg(F.max(done_until).alias("_cut"))
    return raw.join(cut, key, "left").filter(F.col("_cut").isNull() | (F.col("begin_us") > F.col("_cut"))).drop("_cut")


def stamp_runs(df: DataFrame, keys: list[str], stamp_us: str, fs: str, position: str) -> DataFrame:
    """Runs of stamps that follow each other at one spacing (1e-4 of it, and 1e-8 s, aside): one row each.

    (keys, run_no, first_position, n_stamps, begin_us, end_us).
    """


    def breaks(now: Column, was: Column) -> Column:
        step, spacing = (now[stamp_us] - was[stamp_us]) / 1e6, 1 / now[fs]
        return F.coalesce(F.abs(step - spacing) > 1e-8 + 1e-4 * F.abs(spacing), F.lit(True))

    day = F.floor(F.col(stamp_us) / F.lit(DAY_US)).cast("bigint")
    rows = sharded_runs(df, keys, day, [stamp_us, position], [stamp_us, fs], breaks, "run_no")
    return rows.groupBy(*keys, "run_no").agg(F.min(position).alias("first_position"), F.count("*").alias("n_stamps"), F.min(stamp_us).alias("begin_us"), F.max(stamp_us).alias("end_us"))


def window_chain(segmented: DataFrame, key: str, length_us: int) -> DataFrame:
    """Greedy windows of ``length_us`` over each segment: (key, segment_id, window_begin, window_end).

    A window begins at a row's begin, the next one at the first row that begins
    at or after its end; the last one must end by the begin of the segment's
    last row. So a window is known once a row at or after its end comes: one walk
    over the sorted begins with two numbers of state, whatever the segment's
    length. Segments of one row have no window.
    """
    import pandas as pd

    if length_us <= 0:
        raise ValueError("the window length must be positive")
    schema = StructType([StructField(key, segmented.schema[key].dataType), *[StructField(c, LongType()) for c in ("segment_id", "window_begin", "window_end")]])

    def walk(batches):
        at, start = None, 0
        for batch in batches:
            found = []
            for k, seg, b in zip(batch[key], batch["segment_id"], batch["begin_us"], strict=True):
                if (k, seg) != at:
                    at, start = (k, seg), b
                elif b >= start + length_us:
                    found.append((k, seg, start, start + length_us))
                    start = b
            yield pd.DataFrame(found, columns=[key, "segment_id", "window_begin", "window_end"])

    rows = segmented.select(key, F.col("segment_id").cast("bigint"), "begin_us").filter(F.col("begin_us").isNotNull())
    return rows.repartition(key, "segment_id").sortWithinPartitions(key, "segment_id", "begin_us").mapInPandas(walk, schema)
