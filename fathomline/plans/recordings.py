"""Recordings behind a catalog: scans of folders, and samples of time ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog as C
from ..operators.traces import placed
from ..sources import hdf5, segy

SEGY = "SEGY"


def scan_folder(spark: SparkSession, folder: str, system: str, known: DataFrame | None = None, opener: Callable = hdf5.open_hdf5) -> DataFrame:
    """Catalog rows of the files of a system under a folder, with ``error`` where one can't be described; files in ``known`` aren't opened."""
    return segy.scan_segy(spark, folder, known) if system == SEGY else hdf5.scan(spark, folder, system, known, opener)


def read_range(segmented: DataFrame, windows: DataFrame, key: str, reader: Callable[[DataFrame], DataFrame], order: list[str] = C.ORDER) -> DataFrame:
    """(key, channel, it, x): each key's window read from its files, zeros between segments.

    ``reader`` gives the traces (file, slice, channel, samples) of slices (file,
    first_sample, nt), ``slice`` being "first_sample:nt". Only the samples of the window are read.
    """
    plan = C.read_plan(segmented, windows, key, order)
    w = Window.partitionBy(key).orderBy(*order)
    total = F.sum(F.col("zeros_before") + F.col("n_samples")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    plan = plan.select(key, "file", F.concat_ws(":", "sample_from", "n_samples").alias("slice"), F.col("sample_from").alias("first_sample"), F.col("n_samples").alias("nt"), "zeros_before", (total - F.col("n_samples")).alias("_at"))
    traces = reader(plan.select("file", "first_sample", "nt").distinct()).select("file", "slice", "channel", "samples")
    return placed(plan.drop("first_sample", "nt").join(traces, ["file", "slice"]), [key, "channel"], "_at", "zeros_before")


def file_reader(system: str, convert: bool = False, opener: Callable = hdf5.open_hdf5) -> Callable[[DataFrame], DataFrame]:
    """A reader of slices for ``read_range`` and the jobs."""

    def read(slices: DataFrame) -> DataFrame:
        return segy.read_pieces(slices) if system == SEGY else hdf5.read_files(slices, (None, None), convert, opener)

    return read
