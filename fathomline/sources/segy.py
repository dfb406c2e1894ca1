"""SEG-Y files: one row per trace, decoded with numpy in the tasks that read the files.

The binary header's interval, sample count and format count where they make
sense of the file's size; else one of n_traces and n_samples, and the interval,
must be given. Formats 1 (hexadecimal float), 2 and 3 (integers), 5 (IEEE) and
8 (bytes); byte order by which one gives more plausible values of the first
trace, big-endian on a tie. ``.gz`` files are unpacked.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

FILE_HEADER, TRACE_HEADER = 3600, 240
INTERVAL_AT, COUNT_AT, FORMAT_AT, TIME_AT = 3216, 3220, 3224, 156
# fixed values: sample formats of the standard and their widths in bytes
WIDTHS = {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}
LOOKED_AT = 20_000  # samples of the first trace that byte order is judged by

SCHEMA = StructType([StructField("file", StringType()), StructField("channel", IntegerType()), StructField("samples", ArrayType(FloatType())), StructField("fs", DoubleType()), StructField("nt", IntegerType()), StructField("nx", IntegerType()), StructField("begin_us", LongType()), StructField("units", StringType()), StructField("dx", DoubleType()), StructField("gauge_length_m", DoubleType())])


def ibm_to_float(words: np.ndarray) -> np.ndarray:
    w = words.astype(np.int64)
    return (1 - 2 * (w >> 31 & 1)) * ((w & 0xFFFFFF) / float(1 << 24)) * np.power(16.0, (w >> 24 & 0x7F) - 64)


def decode(raw: bytes, fmt: int, endian: str) -> np.ndarray:
    """Samples of a byte string as doubles."""
    if fmt == 1:
        return ibm_to_float(np.frombuffer(raw, endian + "u4"))
    kind = {2: "i4", 3: "i2", 5: "f4", 8: "i1"}[fmt]
    return np.frombuffer(raw, endian + kind).astype(np.float64)


def plausible(x: np.ndarray) -> float:
    """Share of values that are 0 or of a size between 1e-30 and 1e30."""
    if not len(x):
        return 0.0
    a = np.abs(x)
    return float(np.mean(np.isfinite(x) & ((a == 0) | ((a >= 1e-30) & (a <= 1e30)))))


def byte_order(raw: bytes, fmt: int) -> str:
    with np.errstate(all="ignore"):
        return "<" if plausible(decode(raw, fmt, "<")) > plausible(decode(raw, fmt, ">")) else ">"


def geometry(size: int, header_ns: int, width: int, n_traces: int | None, n_samples: int | None) -> tuple[int, int]:
    """(traces, samples per trace) of a file of ``size`` bytes."""
    body = size - FILE_HEADER
    if n_samples is None and n_traces is None and header_ns > 0 and body % (TRACE_HEADER + header_ns * width) == 0:
        return body // (TRACE_HEADER + header_ns * width), header_ns
    if n_samples is None and n_traces:
        per = body // n_traces - TRACE_HEADER
        if body % n_traces or per <= 0 or per % width:
            raise ValueError(f"{body} bytes can't be {n_traces} traces")
        return n_traces, per // width
    if n_samples:
        if body % (TRACE_HEADER + n_samples * width):
            raise ValueError(f"{body} bytes can't be traces of {n_samples} samples")
        found = body // (TRACE_HEADER + n_samples * width)
        if n_traces and n_traces != found:
            raise ValueError(f"{found} traces found, {n_traces} expected")
        return found, n_samples
    raise ValueError("the header has no usable sample count: give n_traces or n_samples")


def header_time_us(trace_header: bytes) -> int | None:
    year, day, hour, minute, second = np.frombuffer(trace_header[TIME_AT : TIME_AT + 10], ">i2").astype(int)
    if not (1970 <= year <= 2100 and 1 <= day <= 366 and 0 <= hour < 24 and 0 <= minute < 60 and 0 <= second < 60):
        return None
    at = datetime(year, 1, 1, tzinfo=UTC) + timedelta(days=int(day) - 1, hours=int(hour), minutes=int(minute), seconds=int(second))
    return int(at.timestamp()) * 1_000_000


def decode_file(raw: bytes, *, n_traces: int | None = None, n_samples: int | None = None, sample_interval: float | None = None, sample_format: int | None = None, endian: str | None = None, conversion_factor: float = 1.0, begin_us: int | None = None) -> dict:
    """Header fields and the (traces, samples) matrix of one file."""
    interval, count, code = (int(np.frombuffer(raw[a : a + 2], ">i2")[0]) for a in (INTERVAL_AT, COUNT_AT, FORMAT_AT))
    fmt = sample_format or (code if code in WIDTHS else 5)
    if fmt not in WIDTHS:
        raise ValueError(f"unknown sample format {fmt}")
    seconds = sample_interval or interval / 1e6
    if seconds <= 0:
        raise ValueError("the header has no sample interval: give sample_interval")
    nx, ns = geometry(len(raw), count, WIDTHS[fmt], n_traces, n_samples)
    width = ns * WIDTHS[fmt]
    first = raw[FILE_HEADER + TRACE_HEADER :][: min(width, LOOKED_AT * WIDTHS[fmt])]
    order = endian or byte_order(first, fmt)
    table = np.frombuffer(raw[FILE_HEADER:], np.uint8).reshape(nx, TRACE_HEADER + width)[:, TRACE_HEADER:]
    x = decode(np.ascontiguousarray(table).tobytes(), fmt, order).reshape(nx, ns) * conversion_factor
    start = begin_us if begin_us is not None else header_time_us(raw[FILE_HEADER : FILE_HEADER + TRACE_HEADER])
    return {"fs": 1.0 / seconds, "nt": ns, "nx": nx, "begin_us": start, "data": x.astype(np.float32)}


def encode_file(data: np.ndarray, interval_us: int, begin: tuple[int, int, int, int, int] | None = None, endian: str = ">") -> bytes:
    """A SEG-Y file of IEEE samples; ``begin`` is (year, day of year, hour, minute, second)."""
    head = bytearray(FILE_HEADER)
    for at, v in ((INTERVAL_AT, interval_us), (COUNT_AT, data.shape[1]), (FORMAT_AT, 5)):
        head[at : at + 2] = np.array([v], ">i2").tobytes()
    trace = bytearray(TRACE_HEADER)
    if begin:
        trace[TIME_AT : TIME_AT + 10] = np.array(begin, ">i2").tobytes()
    return bytes(head) + b"".join(bytes(trace) + row.astype(endian + "f4").tobytes() for row in data)


def read_segy(spark: SparkSession, path: str, *, units: str = "unknown", dx: float | None = None, gauge_length_m: float | None = None, **options) -> DataFrame:
    """Traces of all SEG-Y files under ``path`` (a folder, file or glob)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                f = decode_file(gzip.decompress(raw) if name.lower().endswith(".gz") else raw, **options)
                n = f["nx"]
                yield pd.DataFrame({"file": [name] * n, "channel": np.arange(n, dtype=np.int32), "samples": list(f["data"]), "fs": f["fs"], "nt": f["nt"], "nx": n, "begin_us": pd.array([f["begin_us"]] * n, dtype="Int64"), "units": units, "dx": dx, "gauge_length_m": gauge_length_m})

    return files.mapInPandas(unpack, SCHEMA)


def segy_catalog(traces: DataFrame) -> DataFrame:
    """Catalog rows (file, begin_us, end_us, fs, nt, nx, first_sample) of decoded files."""
    from pyspark.sql import functions as F

    one = traces.groupBy("file").agg(F.first("begin_us").alias("begin_us"), F.first("fs").alias("fs"), F.first("nt").cast("bigint").alias("nt"), F.first("nx").alias("nx"), F.first("dx").alias("dx"), F.first("gauge_length_m").alias("gauge_length_m"))
    return one.withColumns({"end_us": F.col("begin_us") + F.rint((F.col("nt") - 1) * 1e6 / F.col("fs")).cast("bigint"), "first_sample": F.lit(0).cast("bigint")})


def head_of(path: str) -> tuple[bytes, int]:
    """The headers of a file and its first trace, and its size; a packed file is unpacked for the size alone."""
    if not path.lower().endswith(".gz"):
        with open(path, "rb") as f:
            head = f.read(FILE_HEADER + TRACE_HEADER)
            return head, f.seek(0, 2)
    with gzip.open(path, "rb") as f:
        head = f.read(FILE_HEADER + TRACE_HEADER)
        size = len(head)
        while part := f.read(1 << 20):
            size += len(part)
        return head, size


def describe_file(head: bytes, size: int, *, n_traces: int | None = None, n_samples: int | None = None, sample_interval: float | None = None, sample_format: int | None = None, begin_us: int | None = None) -> dict:
    """The catalog row of a file from its headers, without decoding a sample."""
    interval, count, code = (int(np.frombuffer(head[a : a + 2], ">i2")[0]) for a in (INTERVAL_AT, COUNT_AT, FORMAT_AT))
    fmt, seconds = sample_format or (code if code in WIDTHS else 5), sample_interval or interval / 1e6
    if fmt not in WIDTHS or seconds <= 0:
        raise ValueError("the headers have no sample format or interval")
    nx, nt = geometry(size, count, WIDTHS[fmt], n_traces, n_samples)
    begin = begin_us if begin_us is not None else header_time_us(head[FILE_HEADER:])
    return {"begin_us": begin, "end_us": None if begin is None else begin + round((nt - 1) * seconds * 1e6), "fs": 1 / seconds, "nt": nt, "nx": nx, "first_sample": 0}


def list_segy(spark: SparkSession, folder: str) -> DataFrame:
    """(file) of the SEG-Y files under a folder; nothing is read."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("file"))
    return files.filter(F.lower("file").rlike(r"\.(segy|sgy)(\.gz)?$"))


def scan_segy(spark: SparkSession, folder: str, known: DataFrame | None = None, **options) -> DataFrame:
    """Catalog rows of SEG-Y files, as ``hdf5.scan`` gives them; files in ``known`` aren't opened."""
    from .hdf5 import CATALOG

    files = list_segy(spark, folder)
    if known is not None:
        files = files.join(known.select("file").distinct(), "file", "left_anti")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch["file"]:
                try:
                    found.append({"file": name} | describe_file(*head_of(name), **options))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is that file's
                    found.append({"file": name, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(found, columns=CATALOG.names, dtype=object)

    return files.repartition("file").mapInPandas(rows, CATALOG)


def read_pieces(files: DataFrame, **options) -> DataFrame:
    """Traces of slices of files (file, first_sample, nt), as ``hdf5.read_files`` gives them."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, first, count in zip(batch["file"], batch["first_sample"], batch["nt"], strict=True):
                with (gzip.open if name.lower().endswith(".gz") else open)(name, "rb") as src:
                    f = decode_file(src.read(), **options)
                lo = 0 if pd.isna(first) else int(first)
                x = f["data"][:, lo : None if pd.isna(count) else lo + int(count)]
                n, begin = f["nx"], None if f["begin_us"] is None else f["begin_us"] + round(lo * 1e6 / f["fs"])
                yield pd.DataFrame({"file": [name] * n, "channel": np.arange(n, dtype=np.int32), "samples": list(x), "fs": f["fs"], "nt": x.shape[1], "nx": n, "begin_us": pd.array([begin] * n, dtype="Int64"), "units": "unknown", "dx": None, "gauge_length_m": None, "slice": f"{'' if pd.isna(first) else int(first)}:{'' if pd.isna(count) else int(count)}"})

    return files.select("file", "first_sample", "nt").repartition("file", "first_sample").mapInPandas(unpack, StructType([*SCHEMA.fields, StructField("slice", StringType())]))
