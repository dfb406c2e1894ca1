"""Processed recordings, event cut-outs and catalogs as parquet and text tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import iso_timestamp, parse_iso
from ..operators.catalog import COLUMNS, with_columns

EVENT_REQUIRED = ["event_id", "event_us", "begin_us", "dt", "event_time_index", "samples", "channel"]
# fixed values: the column names of catalogs kept as text, and an older one
TEXT_NAMES = {"file": "file", "begin_us": "begTime", "end_us": "endTime", "fs": "fs", "nt": "nt", "nx": "nChannels", "dx": "dCh", "gauge_length_m": "GaugeLen", "first_sample": "firstSample"}
OLD_NAMES = {"startTime": "begTime"}
MISSING = "-1"


def catalog_format(path: str) -> str:
    """parquet or csv, by the extension; none counts as csv."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[1] if "." in name else ""
    if ext in ("parquet", "parq"):
        return "parquet"
    if ext in ("csv", "txt", ""):
        return "csv"
    raise ValueError(f"no catalog format for .{ext}")


def write_processed(traces: DataFrame, path: str, mode: str = "append") -> None:
    """Processed traces, in folders of their day, so that reads by time skip the others."""
    dated = traces.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("begin_us") / 86_400_000_000).cast("int")))
    dated.write.mode(mode).partitionBy("day").parquet(path)


def read_processed(spark: SparkSession, path: str, convert: bool = True, factor: Column | None = None) -> DataFrame:
    """Processed traces; with ``convert`` in microstrain or microstrain/s (times the vendor's factor where there is one)."""
    rows = spark.read.parquet(path)
    if not convert:
        return rows
    scale = F.lit(1e6) * (F.when(F.col("origin").isin("OptaSense", "APSensing"), F.coalesce(factor, F.lit(1.0))).otherwise(1.0) if factor is not None else F.lit(1.0))
    rate = F.col("units").endswith("/s") if "units" in rows.columns else F.lit(False)
    return rows.withColumns({"samples": F.transform("samples", lambda x: x.cast("double") * scale), "units": F.when(rate, "microstrain/s").otherwise("microstrain")})


def write_event(rows: DataFrame, path: str, overwrite: bool = False, keep: bool = False) -> None:
    """Event cut-outs; an output that is there is an error unless ``overwrite``, which with ``keep`` spares other events."""
    missing = [c for c in EVENT_REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"event columns missing: {missing}")
    rows.withColumn("samples", F.transform("samples", lambda x: x.cast("float"))).write.mode("overwrite" if overwrite else "errorifexists").option("partitionOverwriteMode", "dynamic" if keep else "static").partitionBy("event_id").parquet(path)


def read_event(spark: SparkSession, path: str, first_sample: int = 0, n_samples: int | None = None) -> DataFrame:
    """Event cut-outs with their time axis on the event: t0_sec is the first sample's time from it."""
    rows = spark.read.parquet(path)
    size = F.size("samples") if n_samples is None else F.lit(n_samples)
    return rows.withColumns({"samples": F.slice("samples", F.lit(first_sample + 1), size), "t0_sec": -(F.col("event_time_index") - first_sample) * F.col("dt")})


def write_catalog(catalog: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Catalog, sorted by begin, with its system where it has one.

    As text: blanks between columns, ISO times in UTC, -1 for what is missing.
    """
    own = ["system"] if "system" in catalog.columns else []
    rows = catalog.select(*COLUMNS, *own).orderBy("begin_us", "file", "first_sample")
    if catalog_format(path) == "parquet":
        rows.write.mode(mode).parquet(path)
        return
    shown = {c: iso_timestamp(F.col(c)) if c in ("begin_us", "end_us") else F.col(c).cast("string") for c in COLUMNS}
    text = [F.coalesce(F.when(F.isnan(F.col(c).try_cast("double")), None).otherwise(shown[c]), F.lit(MISSING)).alias(n) for c, n in TEXT_NAMES.items()]
    rows.select(*text, *own).write.mode(mode).option("header", True).option("sep", " ").csv(path)


def read_catalog(spark: SparkSession, path: str, undo_missing: bool = True, system: str | None = None) -> DataFrame:
    """Catalog of either format; -1 in text becomes null again unless ``undo_missing`` is off.

    ``system`` names the system of a catalog that doesn't; of one that does, its rows are kept. Columns may be parted by several blanks,
    and stand in any order; those the catalog lacks are null (first_sample 0).
    """
    if catalog_format(path) == "parquet":
        rows = spark.read.parquet(path)
        stamps = {new: F.unix_micros(old) for old, new in (("begin_time", "begin_us"), ("end_time", "end_us")) if old in rows.columns and new not in rows.columns}
        rows = rows.withColumns(stamps).drop(*[o for o in ("begin_time", "end_time") if o in rows.columns]) if stamps else rows
    else:
        lines = spark.read.text(path).filter(F.trim("value") != "")
        head = lines.first()
        names = [OLD_NAMES.get(n, n) for n in re.split(r"\s+", head[0].strip())] if head else list(TEXT_NAMES.values())
        cells = F.regexp_replace(F.trim("value"), r'\s+(?=(?:[^"]*"[^"]*")*[^"]*$)', " ")  # blanks outside of quotes
        schema = StructType([StructField(n, StringType()) for n in names])
        rows = lines.filter(F.col("value") != head[0]) if head else lines
        rows = rows.select(F.from_csv(cells, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": " "}).alias("r")).select("r.*")
        rows = rows.withColumnsRenamed({n: c for c, n in TEXT_NAMES.items()})
        kinds = {"file": "string", "fs": "double", "dx": "double", "gauge_length_m": "double", "nx": "int"}

        def value(c: str) -> Column:
            text = F.when(F.col(c) != MISSING, F.col(c)) if undo_missing and c != "file" else F.col(c)
            if c in ("begin_us", "end_us"):
                return F.coalesce(parse_iso(text), text.try_cast("bigint")).alias(c)
            return (text.try_cast("double").cast(kinds.get(c, "bigint")) if kinds.get(c) != "string" else text).alias(c)

        rows = rows.select(*[value(c) for c in COLUMNS if c in rows.columns], *[c for c in ("system",) if c in rows.columns])
        rows = with_columns(rows) if "system" not in rows.columns else with_columns(rows, "system")
    if system is not None:
        rows = rows.filter(F.col("system") == system) if "system" in rows.columns else rows.withColumn("system", F.lit(system))
    return rows
