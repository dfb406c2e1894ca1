"""Begin, end, rate and count of catalog rows, with the missing one of the four worked out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _positive(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (c > 0), c)


def resolve_times(df: DataFrame) -> DataFrame:
    """Adds b_us, e_us (first and last sample), rate, n to catalog rows.

    end = begin + (n - 1) / rate. A value that is null, NaN, zero or negative is
    missing; columns of these names are replaced. One missing value follows from the other three. Where it can't be
    found (two are missing, or the rate of a single sample) it stays null.
    """
    b0, e0 = (F.when(F.unix_micros(c) > 0, F.unix_micros(c)) for c in (F.col("begin_time"), F.col("end_time")))
    out = df.withColumns({"_b": b0, "_e": e0, "_r": _positive("fs"), "_n": F.when(F.col("nt") > 0, F.col("nt").cast("bigint"))})
    span = F.col("_e") - F.col("_b")
    rate = F.coalesce("_r", F.when((F.col("_n") > 1) & (span > 0), (F.col("_n") - 1) * F.lit(1e6) / span))
    out = out.withColumn("rate", rate)
    out = out.withColumn("n", F.coalesce("_n", F.when(span >= 0, F.rint(span * F.col("rate") / 1e6).cast("bigint") + 1)))
    length = F.rint((F.col("n") - 1) * F.lit(1e6) / F.col("rate")).cast("bigint")
    out = out.withColumns({"b_us": F.coalesce(F.col("_b"), F.col("_e") - length), "e_us": F.coalesce(F.col("_e"), F.col("_b") + length)})
    return out.drop("_b", "_e", "_r", "_n")


def break_tolerance() -> Column:
    """2.5 sample spacings in microseconds, from the column ``rate``."""
    return F.lit(2.5e6) / F.col("rate")
