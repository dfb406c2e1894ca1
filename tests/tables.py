"""Small variants of the driver's tables for whole-query tests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

SMALL = Path("/root/testdata/sf0.001")
TABLES = ["das_arrays", "das_catalog", "das_traces", "das_channels", "proc_headers", "sheet_rows", "event_headers", "documents", "pack_sizes"]
CLASHES = ["k", "s", "b", "e", "tol", "rate", "n", "tz", "prev", "_shard", "file_", "pos", "unit_name", "factor", "look", "code", "stamp", "us", "profile", "cell_no", "status", "group", "tokens", "ids", "rank"]


def variant(spark, kind: str, path) -> str:
    """Tables without rows, with only nulls, with rows that repeat and null columns, or with extra columns."""
    for t in TABLES:
        df = spark.read.parquet(str(SMALL / f"{t}.parquet"))
        nulls = df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        if kind == "empty":
            df = df.limit(0)
        elif kind == "nulls":
            df = nulls
        elif kind == "mixed":
            df = df.unionByName(df.limit(5)).unionByName(nulls)
        elif kind == "extra":
            have = {c.lower() for c in df.columns}
            df = df.withColumns({c: F.lit("clash") for c in CLASHES if c not in have})
        df.coalesce(2).write.parquet(str(path / f"{t}.parquet"))
    return str(path)
