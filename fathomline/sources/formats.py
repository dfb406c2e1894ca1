"""spark.read.format("segy") and spark.read.format("das-hdf5"): one partition per file, slices pushed into the read.

Register once per session with ``register(spark)``. Options: ``channels`` as
"a:b" (end exclusive), ``first_sample``, ``n_samples``; for SEG-Y also the
options of ``segy.decode_file``, for HDF5 ``convert``. Filters on ``channel`` narrow the slice;
``register`` turns filter pushdown to Python sources on for the session.
"""

from __future__ import annotations

import glob as globbing
import gzip
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.types import StructType

from . import hdf5, segy

NUMBERS = {"n_traces": int, "n_samples": int, "sample_interval": float, "sample_format": int, "conversion_factor": float, "begin_us": int}


def list_files(pattern: str, endings: tuple[str, ...]) -> list[str]:
    """Sorted files of a path, folder or glob, each once."""
    found: set[str] = set()
    for p in pattern.split(","):
        for hit in globbing.glob(p.strip().removeprefix("file:"), recursive=True):
            if os.path.isdir(hit):
                found.update(os.path.join(d, f) for d, _, fs in os.walk(hit) for f in fs if f.lower().endswith(endings))
            else:
                found.add(hit)
    return sorted(found)


class OneFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FileReader(DataSourceReader):
    endings: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.options = dict(options)
        a, _, b = self.options.get("channels", ":").partition(":")
        self.low, self.high = int(a) if a else 0, int(b) if b else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - the interface's name
        for f in filters:
            if getattr(f, "attribute", None) == ("channel",) and isinstance(f, GreaterThanOrEqual | LessThan | EqualTo):
                if not isinstance(f, LessThan):
                    self.low = max(self.low, int(f.value))
                if not isinstance(f, GreaterThanOrEqual):
                    top = int(f.value) + isinstance(f, EqualTo)
                    self.high = top if self.high is None else min(self.high, top)
            yield f  # the engine tests it again

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.options["path"], self.endings)
        if not files:
            raise FileNotFoundError(self.options["path"])
        return [OneFile(p) for p in files]

    def bounds(self) -> tuple[int | None, int | None]:
        first, count = self.options.get("first_sample"), self.options.get("n_samples")
        return int(first) if first else None, int(count) if count else None


class SegyReader(FileReader):
    endings = (".segy", ".sgy", ".segy.gz")

    def read(self, partition: OneFile) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            raw = f.read()
        opts = {k: kind(self.options[k]) for k, kind in NUMBERS.items() if k in self.options and k != "n_samples"}
        if "samples_per_trace" in self.options:
            opts["n_samples"] = int(self.options["samples_per_trace"])
        d = segy.decode_file(gzip.decompress(raw) if partition.path.lower().endswith(".gz") else raw, **opts)
        first, count = self.bounds()
        lo = first or 0
        x = d["data"][:, lo : None if count is None else lo + count]
        begin = None if d["begin_us"] is None else d["begin_us"] + round(lo * 1e6 / d["fs"])
        for ch in range(self.low, min(d["nx"], self.high if self.high is not None else d["nx"])):
            yield partition.path, ch, x[ch].tolist(), d["fs"], x.shape[1], d["nx"], begin, self.options.get("units", "unknown"), None, None


class Hdf5Reader(FileReader):
    endings = (".h5", ".hdf5")

    def read(self, partition: OneFile) -> Iterator[tuple]:
        with hdf5.open_hdf5(partition.path) as f:
            d = hdf5.decode_any(f, (self.low, self.high), *self.bounds(), self.options.get("convert", "false").lower() == "true")
        for i, x in enumerate(d["data"]):
            yield partition.path, self.low + i, x.tolist(), d["fs"], len(x), len(d["data"]), d["begin_us"], d["units"], d["dx"], d["gauge_length_m"], d["kind"], d["origin"], d["t0_sec"], d["raw_meta"]


class SegySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> StructType:
        return segy.SCHEMA

    def reader(self, schema: StructType) -> SegyReader:
        return SegyReader(self.options)


class Hdf5Source(SegySource):
    @classmethod
    def name(cls) -> str:
        return "das-hdf5"

    def schema(self) -> StructType:
        return hdf5.TRACES

    def reader(self, schema: StructType) -> Hdf5Reader:
        return Hdf5Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SegySource, Hdf5Source):
        spark.dataSource.register(source)
