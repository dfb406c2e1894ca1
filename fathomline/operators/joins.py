"""Interval and nearest joins as equi-joins on time buckets or grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], bucket_us: int, on: list[str] | None = None, closed: bool = False) -> DataFrame:
    """Pairs of rows whose spans meet: left begins before right ends, and ends after it begins.

    Both sides are put into time buckets; a pair is kept only in the first bucket
    both are in, so none comes twice. Spans are in microseconds.
    """
    (lb, le), (rb, re_) = left_span, right_span
    cell = lambda c: F.floor(c / F.lit(bucket_us)).cast("bigint")
    a = left.withColumn("_lo", cell(F.col(lb))).withColumn("_cell", F.explode(F.sequence(F.col("_lo"), F.greatest(cell(F.col(le)), F.col("_lo")))))
    b = right.withColumn("_ro", cell(F.col(rb))).withColumn("_cell", F.explode(F.sequence(F.col("_ro"), F.greatest(cell(F.col(re_)), F.col("_ro")))))
    pairs = a.join(b, ["_cell", *(on or [])])
    meet = (F.col(lb) <= F.col(re_)) & (F.col(le) >= F.col(rb)) if closed else (F.col(lb) < F.col(re_)) & (F.col(le) > F.col(rb))
    return pairs.filter((F.col("_cell") == F.greatest("_lo", "_ro")) & meet).drop("_cell", "_lo", "_ro")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], shard_us: int = 3_600_000_000) -> DataFrame:
    """Left rows with the ``values`` of the latest right row of the same ``on`` at or before them, null where there is none.

    Of right rows of one time the one with the greatest values holds. Both sides
    are ordered together inside (on, time shard); one row a shard carries its
    last right row to the shards after it.
    """
    shard = lambda t: F.floor(t / F.lit(shard_us)).cast("bigint")
    a = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"))
    b = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_left"), F.struct(*values).alias("_val"))
    rows = a.unionByName(b, allowMissingColumns=True).filter("_t is not null").withColumn("_shard", shard(F.col("_t")))
    inside = Window.partitionBy(*on, "_shard").orderBy("_t", "_left", "_val")
    rows = rows.withColumns({"_seen": F.last("_val", ignorenulls=True).over(inside), "_end": F.lead(F.lit(True)).over(inside).isNull()})
    across = Window.partitionBy(*[f"_k{i}" for i in range(len(on))]).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("_end").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], F.col("_shard").alias("_s"), F.col("_seen").alias("_last"))
    ends = ends.withColumn("_carry", F.last("_last", ignorenulls=True).over(across)).drop("_last")
    cond = rows["_shard"] == ends["_s"]
    for i, k in enumerate(on):
        cond = cond & rows[k].eqNullSafe(ends[f"_k{i}"])
    out = rows.filter("_left = 1").join(ends, cond, "left").select("_row", F.coalesce("_seen", "_carry").alias("_found"))
    return out.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def common_shot_pairs(channels: DataFrame, source: int, channel: str = "channel") -> DataFrame:
    """The source channel with every channel."""
    return channels.select(F.lit(source).cast(channels.schema[channel].dataType).alias("ch1"), F.col(channel).alias("ch2"))


def common_offset_pairs(channels: DataFrame, key: str, channel: str, lat: str, lon: str, offset_km: float, tol_km: float | None = None) -> DataFrame:
    """For each channel the later one whose distance is nearest to ``offset_km``: (key, ch1, ch2, distance_km).

    Ties go to the lowest channel; with ``tol_km`` the distance must be within it.
    A key is one cable, so its channels are bounded by the instrument; they are
    compared in blocks of rows, and no pairs are emitted but the chosen ones.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import DoubleType, StructField, StructType

    kinds = channels.schema
    schema = StructType([StructField(key, kinds[key].dataType), StructField("ch1", kinds[channel].dataType), StructField("ch2", kinds[channel].dataType), StructField("distance_km", DoubleType())])

    def nearest(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(channel)
        ch, la, lo = rows[channel].to_numpy(), np.radians(rows[lat].to_numpy(float)), np.radians(rows[lon].to_numpy(float))
        out = []
        for at in range(0, len(ch) - 1, 512):
            i = np.arange(at, min(at + 512, len(ch) - 1))
            h = np.sin((la[None, :] - la[i, None]) / 2) ** 2 + np.cos(la[i, None]) * np.cos(la[None, :]) * np.sin((lo[None, :] - lo[i, None]) / 2) ** 2
            d = 2 * 6371.0088 * np.arcsin(np.minimum(1.0, np.sqrt(h)))
            off = np.where(np.arange(len(ch))[None, :] > i[:, None], np.round(np.abs(d - offset_km), 9), np.inf)
            j = np.argmin(off, axis=1)
            ok = np.isfinite(off[np.arange(len(i)), j]) & ((tol_km is None) | (off[np.arange(len(i)), j] <= (tol_km or 0)))
            out.append(pd.DataFrame({key: group[0], "ch1": ch[i[ok]], "ch2": ch[j[ok]], "distance_km": d[np.arange(len(i)), j][ok]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in (key, "ch1", "ch2", "distance_km")})

    return channels.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(channel).isNotNull()).select(key, channel, lat, lon).groupBy(key).applyInPandas(nearest, schema)
