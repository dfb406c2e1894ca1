"""HDF5 recordings of three vendors' layouts, and the processed and event layouts.

A layout is known by the names at a file's root. Each has a describer, which
gives the catalog rows of a file from its headers alone, and a decoder, which
reads a slice of the samples. Both work on any object with the same indexing
(``f[path]``, ``path in f``, ``.attrs``); h5py is needed to open real files.

``scan`` makes a catalog: paths are listed without reading, those already known
are left out before any file is opened, and each task opens its files one by
one. A file that can't be described becomes a row with its error, not a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from ..functions.scalars import FLIPPED_DRAWING, FLIPPED_VERSION, PHOTO_ELASTIC
from .segy import SCHEMA

TRACES = StructType([*SCHEMA.fields, StructField("system", StringType()), StructField("origin", StringType()), StructField("t0_sec", DoubleType()), StructField("raw_meta", MapType(StringType(), StringType()))])
SLICES = StructType([*TRACES.fields, StructField("slice", StringType())])
CATALOG = StructType([StructField("file", StringType()), StructField("begin_us", LongType()), StructField("end_us", LongType()), StructField("fs", DoubleType()), StructField("nt", LongType()), StructField("nx", IntegerType()), StructField("dx", DoubleType()), StructField("gauge_length_m", DoubleType()), StructField("first_sample", LongType()), StructField("error", StringType())])
STRIDE = 1e-4  # relative part by which the step between two stamps may differ from one spacing, beside 1e-8 s

# fixed values: group names that tell a layout, in the order they are tried, and attributes that tell where processed data came from
LAYOUTS = [("Data", "Proc"), ("acqSpec", "ASN"), ("Acquisition", "OptaSense"), ("ProcessingServer", "APSensing")]
ORIGINS = [("AcquisitionId", "OptaSense"), ("acqSpec.YvsXDelay", "ASN"), ("ProcessingServer.ClassifierVersion", "APSensing"), ("acquisition.num_channels", "Sintela")]
# fixed values: paths of each system's recordings under their folder
PATHS = {"ASN": r"\d{8}/(?:[^/]+/)?[^/]+\.hdf5", "Proc": r"(?:\d{8}/)?[^/]+\.h5", "OptaSense": r"[^/]+\.h5", "APSensing": r"[^/]+\.h5", "Event": r"[^/]+\.h5"}
# fixed values: attributes of an event cut-out that its columns hold
EVENT_COLUMNS = {"dt_s", "dx_m", "nt", "nx", "begin_time", "end_time", "event_time_index", "unit"}


def kind_of(f) -> str:
    for name, kind in LAYOUTS:
        if name in f:
            return kind
    return "Event" if "data" in f and "event_id" in f["data"].attrs else "Unknown"


def origin_of(f) -> str:
    """The recording system; of processed files by the attributes they kept."""
    kind = kind_of(f)
    if kind != "Proc":
        return kind
    kept = f["Acquisition_origin"].attrs if "Acquisition_origin" in f else {}
    return next((system for key, system in ORIGINS if key in kept), "Unknown")


# ---- values


def _bounds(n: int, first: int | None, count: int | None) -> slice:
    a = max(0, first or 0)
    return slice(a, n if count is None else min(n, a + count))


def _scalar(v):
    a = np.asarray(v)
    return a.reshape(-1)[0].item() if a.size else None


def _value(f, path: str, default=None):
    """First value of a dataset; ``default`` where there is none (an error without one)."""
    if path in f:
        return _scalar(f[path][()])
    if default is None:
        raise KeyError(path)
    return default if default is not ... else None


def _micros(text) -> int:
    at = pd.Timestamp(text.decode() if isinstance(text, bytes) else str(text))
    return (at.tz_localize("UTC") if at.tzinfo is None else at.tz_convert("UTC")).value // 1000


def _plain(v):
    """A stored value as text, number or list."""
    a = np.asarray(v)
    if a.dtype.kind in "SO":
        a = np.array([x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in a.reshape(-1)], object).reshape(a.shape)
    out = a.item() if a.shape == () else a.tolist()
    return None if out == "None" else out


def tree(group, skip: tuple[str, ...] = ("data",)) -> dict:
    """All datasets below a group as nested dicts, without the samples."""
    out = {}
    for key in group.keys():
        if key not in skip:
            item = group[key]
            out[key] = _plain(item[()]) if hasattr(item, "shape") else tree(item, skip)
    return out


def flattened(nested: dict, sep: str = ".", stem: str = "") -> dict:
    """One level, with the names of the levels joined."""
    out = {}
    for k, v in nested.items():
        name = f"{stem}{sep}{k}" if stem else str(k)
        out.update(flattened(v, sep, name) if isinstance(v, dict) else {name: v})
    return out


def texts(meta: dict) -> dict[str, str]:
    return {k: str(_plain(v)) for k, v in flattened(meta).items() if v is not None}


def counts_to_strain(f) -> float:
    """Strain per count of a recording or of what was processed from one; 1 where an attribute is missing."""
    own = f["Acquisition_origin"].attrs if "Acquisition_origin" in f else f["Acquisition"].attrs if "Acquisition" in f else {}
    custom = own if "Acquisition_origin" in f or "Acquisition" not in f else f["Acquisition/Custom"].attrs
    try:
        gauge, index, wave = float(own["GaugeLength"]), float(custom["Fibre Refractive Index"]), float(custom["Laser Wavelength (nm)"]) * 1e-9
        drawing, version = int(custom["FPGA Drawing Number"]), float(_plain(custom["FPGA Version"]))
    except (KeyError, TypeError, ValueError):
        return 1.0
    sign = -1.0 if drawing == FLIPPED_DRAWING and version <= FLIPPED_VERSION else 1.0
    return sign * (np.pi / 2**15) * wave / (4 * np.pi * PHOTO_ELASTIC * index * gauge)


def radians_to_strain(f) -> float:
    """Strain per radian, likewise."""
    try:
        nano = f["Acquisition_origin"].attrs["ProcessingServer.RadiansToNanoStrain"] if "Acquisition_origin" in f else _value(f, "ProcessingServer/RadiansToNanoStrain")
        return 1e-9 * float(nano)
    except (KeyError, TypeError, ValueError):
        return 1.0


def to_strain(f) -> float:
    """The factor to strain (or strain rate) of a file's samples."""
    return {"OptaSense": counts_to_strain, "APSensing": radians_to_strain}.get(origin_of(f), lambda _: 1.0)(f)


# ---- catalog rows from headers


def _row(begin_us: int, end_us: int, fs: float, nt: int, nx: int, dx=None, gauge=None, first: int = 0) -> dict:
    return {"begin_us": begin_us, "end_us": end_us, "fs": fs, "nt": int(nt), "nx": int(nx), "dx": dx, "gauge_length_m": gauge, "first_sample": first}


def _asn_dx(f) -> float | None:
    """Spacing of the channels that were written, which may be every n-th one."""
    if "header/dx" not in f or "header/channels" not in f:
        return None
    ids = np.asarray(f["header/channels"][()]).reshape(-1)[:2]
    return _value(f, "header/dx") * (float(ids[1] - ids[0]) if ids.size > 1 else 1.0)


def describe_asn(f) -> list[dict]:
    begin, dt = _value(f, "header/time") + _value(f, "timing/sampleSkew"), float(_value(f, "header/dimensionRanges/dimension0/unitScale"))
    nt, nx = f["data"].shape
    return [_row(round(begin * 1e6), round((begin + (nt - 1) * dt) * 1e6), 1 / dt, nt, nx, _asn_dx(f), _value(f, "header/gaugeLength", ...))]


def describe_optasense(f) -> list[dict]:
    """A row for each stretch of stamps that follow each other at one spacing; none for files without a recording."""
    if "Acquisition/Raw[0]" not in f:
        return []
    acq, raw = f["Acquisition"], f["Acquisition/Raw[0]"]
    fs = float(raw.attrs["OutputDataRate"])
    us = np.asarray(raw["RawDataTime"][()]).reshape(-1).astype(np.int64)
    nx = f["Acquisition/Custom"].attrs.get("Num Output Channels", raw["RawData"].shape[0])
    step = np.diff(us) * 1e-6
    ends = [0, *(np.nonzero(np.abs(step - 1 / fs) > 1e-8 + STRIDE / fs)[0] + 1), len(us)]
    return [_row(int(us[a]), int(us[b - 1]), fs, b - a, nx, float(acq.attrs.get("SpatialSamplingInterval", 0.0)), float(acq.attrs.get("GaugeLength", 0.0)), int(a)) for a, b in zip(ends, ends[1:], strict=False) if b > a]


def describe_apsensing(f) -> list[dict]:
    if "ProcessingServer" not in f or "Timestamps" not in f:
        return []
    us, shape = np.asarray(f["Timestamps/DataTimestamps"][()])[:, 0].astype(np.int64), f["DAS"].shape
    if not len(us):
        return []
    return [_row(int(us[0]), int(us[-1]), float(_value(f, "ProcessingServer/DataRate")), len(us), shape[1] if shape[0] == len(us) else shape[0], float(_value(f, "ProcessingServer/SpatialSampling")), _value(f, "ProcessingServer/GaugeLength", ...))]


def _known(v) -> float | None:
    return None if v is None or np.isnan(float(v)) else float(v)


def describe_processed(f) -> list[dict]:
    a = f["Data"].attrs
    return [_row(_micros(a["startTime"]), _micros(a["endTime"]), float(a["fs"]), a["nt"], a["nCh"], _known(a.get("dCh")), _known(a.get("GaugeLength")))]


def describe_event(f) -> list[dict]:
    a, (nx, nt) = f["data"].attrs, f["data"].shape
    return [_row(_micros(a["begin_time"]), _micros(a["end_time"]), 1 / float(a["dt_s"]), nt, nx, _known(a.get("dx_m")))]


DESCRIBERS = {"ASN": describe_asn, "OptaSense": describe_optasense, "APSensing": describe_apsensing, "Proc": describe_processed, "Event": describe_event}


def describe(f, kind: str | None = None) -> list[dict]:
    """Catalog rows of a file; a file of another kind than the one asked for has none."""
    found = kind_of(f)
    if found not in DESCRIBERS:
        raise ValueError(f"no reader for {found} files")
    return DESCRIBERS[found](f) if kind in (None, found) else []


# ---- samples


def decode_asn(f, channels: slice, first: int | None, count: int | None, convert: bool) -> dict:
    """Time-first samples over the sensitivity, with the sign turned; strain rate.

    The spacing is that of what was written, which later steps may have thinned
    out, and the begin has the skew that the clock's stamp lacks.
    """
    data = f["data"]
    rows, cols = _bounds(data.shape[0], first, count), slice(*channels.indices(data.shape[1]))
    sens = np.asarray(f["header/sensitivities"][()], float).reshape(-1)
    scale = -float(_value(f, "header/dataScale")) / (sens[cols] if sens.size == data.shape[1] else sens[0])
    dt = float(_value(f, "header/dimensionRanges/dimension0/unitScale", ...) or _value(f, "header/dt"))
    begin = float(_value(f, "header/time")) + float(_value(f, "timing/sampleSkew", ...) or 0.0) + rows.start * dt
    return {"data": (np.asarray(data[rows, cols], float) * scale).T, "fs": 1 / dt, "begin_us": round(begin * 1e6), "units": "strain/s", "dx": _asn_dx(f), "gauge_length_m": _value(f, "header/gaugeLength", ...), "raw_meta": tree(f)}


def decode_optasense(f, channels: slice, first: int | None, count: int | None, convert: bool) -> dict:
    """Channel-first counts as they are: unwrapping is the pipeline's, over the ends of files."""
    acq, raw = f["Acquisition"], f["Acquisition/Raw[0]"]
    data = raw["RawData"]
    cols = _bounds(data.shape[1], first, count)
    meta = dict(acq.attrs) | (dict(f["Acquisition/Custom"].attrs) if "Acquisition/Custom" in f else {})
    return {"data": np.asarray(data[slice(*channels.indices(data.shape[0])), cols], float), "fs": float(raw.attrs["OutputDataRate"]), "begin_us": int(raw["RawDataTime"][cols.start]), "units": "count", "dx": float(acq.attrs.get("SpatialSamplingInterval", 0.0)), "gauge_length_m": float(acq.attrs["GaugeLength"]), "raw_meta": meta}


def decode_apsensing(f, channels: slice, first: int | None, count: int | None, convert: bool) -> dict:
    """Phase rates; the time axis is the one as long as the stamps (the first, if both are)."""
    data = f["DAS"]
    us = np.asarray(f["Timestamps/DataTimestamps"][()])[:, 0]
    cols = _bounds(len(us), first, count)
    timed = data.shape[0] == len(us)
    own = slice(*channels.indices(data.shape[1 if timed else 0]))
    x = np.asarray(data[cols, own], float).T if timed else np.asarray(data[own, cols], float)
    server = f["ProcessingServer"]
    meta = {"ProcessingServer": {k: _scalar(server[k][()]) for k in server.keys()}, "Distances": {k: _scalar(v) for k, v in f["Distances/MeterPositions"].attrs.items()} if "Distances/MeterPositions" in f else {}}
    return {"data": x, "fs": float(_value(f, "ProcessingServer/DataRate")), "begin_us": int(us[cols.start]), "units": "radian/s", "dx": float(_value(f, "ProcessingServer/SpatialSampling")), "gauge_length_m": _value(f, "ProcessingServer/GaugeLength", ...), "raw_meta": meta}


def decode_processed(f, channels: slice, first: int | None, count: int | None, convert: bool) -> dict:
    """Processed samples, channel-first or time-first by which axis has ``nt``; in microstrain with ``convert``."""
    data, a, origin = f["Data"], f["Data"].attrs, origin_of(f)
    nt, dt = int(_scalar(a["nt"])), float(_scalar(a["dt"]))
    cols, own = _bounds(nt, first, count), slice(*channels.indices(int(a["nCh"])))
    x = np.asarray(data[own, cols], float) if data.shape[-1] == nt else np.asarray(data[cols, own], float).T
    units = ("microstrain" if origin == "OptaSense" else "microstrain/s") if convert else {"OptaSense": "count", "APSensing": "radian/s"}.get(origin, "strain/s")
    return {"data": x * (to_strain(f) * 1e6 if convert else 1.0), "fs": float(a["fs"]), "begin_us": _micros(a["startTime"]) + round(cols.start * dt * 1e6), "units": units, "dx": float(a.get("dCh", 0.0)), "gauge_length_m": _known(a.get("GaugeLength")), "raw_meta": {}}


def decode_event(f, channels: slice, first: int | None, count: int | None, convert: bool) -> dict:
    """An event's cut-out, its seconds counted from the event."""
    data, a = f["data"], f["data"].attrs
    cols, dt = _bounds(data.shape[1], first, count), float(a["dt_s"])
    x = np.asarray(data[slice(*channels.indices(data.shape[0])), cols], float)
    return {"data": x, "fs": 1 / dt, "begin_us": _micros(a["begin_time"]) + round(cols.start * dt * 1e6), "units": str(_plain(a.get("unit", "unknown"))), "dx": float(a["dx_m"]), "gauge_length_m": None, "t0_sec": (cols.start - int(a.get("event_time_index", 0))) * dt, "raw_meta": {k: v for k, v in a.items() if k not in EVENT_COLUMNS}}


DECODERS = {"ASN": decode_asn, "OptaSense": decode_optasense, "APSensing": decode_apsensing, "Proc": decode_processed, "Event": decode_event}


def decode_any(f, channels: tuple[int | None, int | None] = (None, None), first: int | None = None, count: int | None = None, convert: bool = False) -> dict:
    kind = kind_of(f)
    if kind not in DECODERS:
        raise ValueError(f"no reader for {kind} files")
    d = DECODERS[kind](f, slice(*channels), first, count, convert)
    return {"t0_sec": 0.0} | d | {"kind": kind, "origin": origin_of(f), "raw_meta": texts(d["raw_meta"])}


# ---- tables


def open_hdf5(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py on every executor") from e
    return h5py.File(path, "r")


def list_recordings(spark: SparkSession, folder: str, system: str | None = None) -> DataFrame:
    """(file, length) of the HDF5 files under a folder, of one system those at its places; nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{h5,hdf5}").load(folder)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "length")
    if system is None:
        return files
    if system not in PATHS:
        raise ValueError(f"unknown system {system}")
    root = folder.removeprefix("file:").rstrip("/")
    return files.filter(F.col("file").rlike(f"{_quoted(root)}/{PATHS[system]}$"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def scan(spark: SparkSession, folder: str, system: str, known: DataFrame | None = None, opener: Callable = open_hdf5) -> DataFrame:
    """Catalog rows of a system's files, with ``error`` instead of values where one can't be described.

    ``known`` has the files (column ``file``) that need no opening.
    """
    files = list_recordings(spark, folder, system).select("file")
    if known is not None:
        files = files.join(known.select("file").distinct(), "file", "left_anti")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch["file"]:
                try:
                    with opener(name) as f:
                        found += [{"file": name} | r for r in describe(f, system)]
                except ImportError:
                    raise
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is that file's
                    found.append({"file": name, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(found, columns=CATALOG.names, dtype=object)

    return files.repartition(F.col("file")).mapInPandas(rows, CATALOG)


def read_files(files: DataFrame, channels: tuple[int | None, int | None] = (None, None), convert: bool = False, opener: Callable = open_hdf5) -> DataFrame:
    """Traces of slices of files: ``files`` has (file, first_sample, nt), the slice of each, null for the whole; only these samples are read. ``slice`` says which one a row is of."""
    start = channels[0] or 0

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, first, count in zip(batch["file"], batch["first_sample"], batch["nt"], strict=True):
                with opener(name) as f:
                    d = decode_any(f, channels, None if pd.isna(first) else int(first), None if pd.isna(count) else int(count), convert)
                n, nt = d["data"].shape
                same = {"fs": d["fs"], "nt": nt, "nx": n, "begin_us": d["begin_us"], "units": d["units"], "dx": d["dx"], "gauge_length_m": d["gauge_length_m"], "system": d["kind"], "origin": d["origin"], "t0_sec": d["t0_sec"]}
                yield pd.DataFrame({"file": [name] * n, "channel": np.arange(start, start + n, dtype=np.int32), "samples": list(d["data"].astype(np.float32)), **same, "raw_meta": [d["raw_meta"]] * n, "slice": f"{'' if pd.isna(first) else int(first)}:{'' if pd.isna(count) else int(count)}"})

    return files.select("file", "first_sample", "nt").repartition(F.col("file"), F.col("first_sample")).mapInPandas(unpack, SLICES)


def read_hdf5(spark: SparkSession, path: str, channels: tuple[int | None, int | None] = (None, None), first: int | None = None, count: int | None = None, convert: bool = False, opener: Callable = open_hdf5) -> DataFrame:
    """Traces of all HDF5 files under ``path`` on a file system that every executor mounts."""
    files = list_recordings(spark, path).select("file", F.lit(first).cast("bigint").alias("first_sample"), F.lit(count).cast("bigint").alias("nt"))
    return read_files(files, channels, convert, opener)
