"""python -m fathomline catalog | windows | events: jobs for spark-submit."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import iso_timestamp, parse_iso
from .operators import catalog as C
from .plans.desample import desample_windows, pending
from .plans.events import cut_samples, extract_plan, extract_status, status_counts
from .plans.recordings import SEGY, file_reader, scan_folder
from .session import cut
from .sources.hdf5 import list_recordings, open_hdf5
from .sources.segy import list_segy
from .sources.tables import catalog_format, read_catalog, write_catalog, write_event, write_processed


def described(spark: SparkSession, folder: str, system: str, known: DataFrame | None, opener: Callable) -> DataFrame:
    """Catalog rows of a folder's files; those that can't be described are told on the screen and left out."""
    rows = cut(scan_folder(spark, folder, system, known, opener))
    for r in rows.filter("error is not null").limit(20).collect():
        print("skipped", r["file"], r["error"])
    return C.with_columns(rows.filter("error is null").withColumn("system", F.lit(system)), "system")


def load_or_build(spark: SparkSession, folder: str, path: str, system: str, overwrite: bool = False, opener: Callable = open_hdf5) -> DataFrame:
    """The catalog at ``path``, brought up to date with the folder's files; built where it can't be read. Known files aren't opened."""
    try:
        known = read_catalog(spark, path, system=system) if not overwrite else None
        known = None if known is None or known.isEmpty() else known
    except (PySparkException, Py4JJavaError):  # not there, or broken: it is built anew
        known = None
    if known is None:
        write_catalog(described(spark, folder, system, None, opener), path)
        return read_catalog(spark, path, system=system)
    rows = C.append(C.with_columns(known, "system"), described(spark, folder, system, known, opener), ["file", "first_sample"], ["begin_us"])
    write_catalog(cut(rows), path)  # cut first: the rows are read from what is overwritten
    return read_catalog(spark, path, system=system)


def open_windows(spark: SparkSession, path: str, length_us: int, since: str | None, until: str | None, system: str, done: str | None, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segmented catalog rows, windows still to process); those whose output ``out`` has are done too."""
    if (since is None) != (until is None):
        raise ValueError("give both --since and --until, or neither")
    rows = C.segments(read_catalog(spark, path).withColumn("key", F.lit(system)), "key")
    windows = C.window_chain(rows, "key", length_us)
    if since is not None:
        lo, hi = parse_iso(F.lit(since)), parse_iso(F.lit(until))
        windows = windows.filter((F.col("window_begin") >= lo) & (F.col("window_begin") < hi))
    there = read_catalog(spark, done).select("file") if done else spark.createDataFrame([], "file string")
    if out:
        there = there.unionByName(written(spark, out, "file"))
    return rows, pending(windows, there, F.col("key"))


def window_list(windows: DataFrame) -> DataFrame:
    return windows.select("file", iso_timestamp(F.col("window_begin")).alias("begin"), iso_timestamp(F.col("window_end")).alias("end"))


def list_windows(spark: SparkSession, path: str, length_us: int, since: str | None, until: str | None, system: str, done: str | None) -> DataFrame:
    """Windows still to process, those of [since, until) if both are given."""
    return window_list(open_windows(spark, path, length_us, since, until, system, done)[1])


def written(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Distinct values of the text column ``name`` in the output ``out``; none where it isn't there yet."""
    try:
        return cut(spark.read.schema(f"{name} string").parquet(out).select(name).distinct())
    except AnalysisException:
        return spark.createDataFrame([], f"{name} string")


def with_samples(rows: DataFrame, reader: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Catalog rows with the channels and samples of their files."""
    rows = rows.withColumn("slice", F.concat_ws(":", "first_sample", "nt"))
    traces = reader(rows.select("file", "first_sample", "nt").distinct()).select("file", "slice", "channel", "samples")
    return rows.join(traces, ["file", "slice"]).drop("slice")


def lost_files(rows: DataFrame, there: DataFrame, folder: str) -> None:
    lost = rows.select("file").distinct().join(there.select("file"), "file", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"files of the catalog not under {folder}: {[r[0] for r in lost]}")


def there(spark: SparkSession, folder: str, system: str) -> DataFrame:
    return list_segy(spark, folder) if system == SEGY else list_recordings(spark, folder).select("file")


def desample_job(spark: SparkSession, rows: DataFrame, windows: DataFrame, folder: str, out: str, f_max: float, order: int, system: str = SEGY, opener: Callable = open_hdf5) -> int:
    """Downsamples the windows and appends them to ``out``, with their catalog beside it; the number of windows written.

    Counts of OptaSense recordings are unwrapped over the ends of files. A window whose files aren't all there is an error.
    """
    windows, rows = cut(windows), cut(rows)
    spans = rows.join(windows.groupBy("key", "segment_id").agg(F.min("window_begin").alias("_from"), F.max("window_end").alias("_until")), ["key", "segment_id"])
    lost_files(spans.filter(C.meets(F.col("_from"), F.col("_until"))), there(spark, folder, system), folder)
    of_segment = rows.groupBy("key", "segment_id").agg(F.first("fs").alias("fs"))
    named = cut(windows.join(of_segment, ["key", "segment_id"]))
    for fs in sorted(r[0] for r in named.select("fs").distinct().collect()):
        wanted = named.filter(F.col("fs") == fs).drop("fs")
        source = with_samples(rows.join(wanted.select("key", "segment_id").distinct(), ["key", "segment_id"], "left_semi"), file_reader(system, False, opener))
        made = desample_windows(source.select("key", "segment_id", "file", "begin_us", "end_us", "channel", "samples"), wanted.select("key", "segment_id", "window_begin", "window_end"), "key", fs, f_max, order, system == "OptaSense")
        write_processed(made.join(wanted.select("key", "segment_id", "window_begin", "window_end", "file"), ["key", "segment_id", "window_begin"]), out)
    return named.count()


def processed_catalog(spark: SparkSession, out: str, path: str) -> DataFrame:
    """Catalog of the processed windows in ``out``, written to ``path``, as the next step's raw catalog."""
    rows = spark.read.parquet(out)
    nt = F.max(F.size("samples")).cast("bigint")
    found = rows.groupBy("file").agg(F.min("begin_us").alias("begin_us"), F.first("fs_out").alias("fs"), nt.alias("nt"), F.countDistinct("channel").cast("int").alias("nx"))
    found = found.withColumns({"end_us": F.col("begin_us") + F.rint((F.col("nt") - 1) * 1e6 / F.col("fs")).cast("bigint"), "system": F.lit("Proc")})
    write_catalog(C.with_columns(found, "system"), path)
    return read_catalog(spark, path)


def event_rows(spark: SparkSession, events: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(events)
    missing = {"event_id", "event_time"} - set(rows.columns)
    if missing:
        raise ValueError(f"event columns missing: {sorted(missing)}")
    return rows.withColumn("event_us", parse_iso(F.col("event_time")))


def cut_events(spark: SparkSession, path: str, events: str, before: float, after: float, folder: str, out: str, overwrite: bool = False, system: str = SEGY, opener: Callable = open_hdf5) -> DataFrame:
    """Cuts the events' samples from their files, writes them to ``out``, one row a channel, and returns the counts by status.

    Missing samples between pieces are zeros. An event that is there is skipped
    unless ``overwrite``; one with pieces missing or of different rates fails.
    """
    rows = event_rows(spark, events).dropDuplicates(["event_id"])
    ev = rows.select("event_id", "event_us")
    done = written(spark, out, "event_id") if not overwrite else spark.createDataFrame([], "event_id string")
    piece = read_catalog(spark, path).withColumn("file", F.struct("file", "first_sample", "fs", F.col("begin_us").alias("row_us")))
    plan = extract_plan(ev.join(done, "event_id", "left_anti"), piece, int(before * 1e6), int(after * 1e6)).select("event_id", "file.*", "offset", "n_samples")
    plan = plan.withColumns({"at_us": F.col("row_us") + F.rint(F.col("offset") * 1e6 / F.col("fs")).cast("bigint"), "first_sample": F.col("first_sample") + F.col("offset"), "first": F.lit(0)})
    plan = cut(plan.withColumn("slice", F.concat_ws(":", "first_sample", "n_samples")).drop("row_us", "offset"))
    slices = plan.select("file", "first_sample", F.col("n_samples").alias("nt")).distinct().join(there(spark, folder, system), "file", "left_semi")
    made = cut_samples(plan.drop("first_sample"), file_reader(system, True, opener)(slices), ["file", "slice"]).withColumn("dt", 1 / F.col("fs")).drop("fs")
    made = cut(made.join(rows, "event_id").withColumn("event_time_index", F.rint((F.col("event_us") - F.col("begin_us")) / 1e6 / F.col("dt")).cast("bigint")))
    write_event(made, out, overwrite=True, keep=True)
    return status_counts(extract_status(ev, made, done))


def event_job(spark: SparkSession, path: str, events: str, before: float, after: float, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, counts by status) of a table of events (event_id, event_time); those that ``out`` has are done."""
    ev = event_rows(spark, events).select("event_id", "event_us")
    plan = extract_plan(ev, read_catalog(spark, path), int(before * 1e6), int(after * 1e6))
    return plan, status_counts(extract_status(ev, plan, written(spark, out, "event_id") if out else spark.createDataFrame([], "event_id string")))


def put(rows: DataFrame, path: str | None) -> None:
    """All rows to ``path``, where one is given; a preview and their number on the screen."""
    if path:
        rows.write.mode("overwrite").option("header", True).format(catalog_format(path)).save(path)
    n = rows.count()
    rows.show(20, False)
    print(n, "rows", f"in {path}" if path else "(--list PATH writes all of them)")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="fathomline")
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("catalog")
    c.add_argument("--from", dest="folder", required=True)
    c.add_argument("--overwrite", action="store_true")
    w = sub.add_parser("windows")
    w.add_argument("--seconds", type=float, default=60)
    w.add_argument("--since")
    w.add_argument("--until")
    w.add_argument("--done")
    w.add_argument("--all", action="store_true")
    w.add_argument("--fmax", type=float, default=0.4)
    w.add_argument("--order", type=int, default=14)
    w.add_argument("--proc-catalog", help="write the catalog of the processed windows here, with --to")
    w.add_argument("--dry-run", action="store_true", help="list only")
    e = sub.add_parser("events")
    e.add_argument("--events", required=True)
    e.add_argument("--before", type=float, default=30)
    e.add_argument("--after", type=float, default=60)
    e.add_argument("--overwrite", action="store_true")
    for s in (w, e):
        s.add_argument("--list", help="write the whole list here, parquet or csv by its extension")
        s.add_argument("--from", dest="folder", help="folder of the recordings, with --to")
        s.add_argument("--to", dest="out", help="do the work and write it here")
    for s in (c, w, e):
        s.add_argument("--catalog", required=True)
        s.add_argument("--system", default=SEGY, choices=[SEGY, "ASN", "OptaSense", "APSensing", "Proc"])
    a = p.parse_args(args)
    if a.job != "catalog" and (a.folder is None) != (a.out is None):
        p.error("give both --from and --to, or neither")
    spark = SparkSession.builder.getOrCreate()
    if a.job == "catalog":
        print(load_or_build(spark, a.folder, a.catalog, a.system, a.overwrite).count(), "files")
    elif a.job == "windows":
        rows, windows = open_windows(spark, a.catalog, int(a.seconds * 1e6), a.since, a.until, a.system, a.done, a.out)
        windows = cut(windows.orderBy("window_begin") if a.all else windows.orderBy("window_begin").limit(1))
        put(window_list(windows).orderBy("begin"), a.list)
        if a.out and not a.dry_run:
            print(desample_job(spark, rows, windows, a.folder, a.out, a.fmax, a.order, a.system), "windows written")
            if a.proc_catalog:
                print(processed_catalog(spark, a.out, a.proc_catalog).count(), "windows in", a.proc_catalog)
    else:
        plan, counts = event_job(spark, a.catalog, a.events, a.before, a.after, a.out if not a.overwrite else None)
        put(plan.orderBy("event_id", "file", "offset"), a.list)
        (cut_events(spark, a.catalog, a.events, a.before, a.after, a.folder, a.out, a.overwrite, a.system) if a.out else counts).show()


if __name__ == "__main__":
    main()
