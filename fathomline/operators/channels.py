"""Channel catalog: names, flags, indices and views of a cable's channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: other names of the columns; of two names for one column the first here holds
ALIASES = {
    "status": "taptest", "index": "index_raw", "ichan_before_taptest": "index_raw", "ichan_after_taptest": "index_taptest", "taptest_channel_index": "index_taptest",
    "longitude": "lon", "latitude": "lat", "elevation": "ele", "azimuth": "azi", "dipping angle": "dip",
}
LEADING, TRAILING = ["index_raw", "fiber", "taptest", "quality", "index_taptest"], ["lat", "lon", "ele", "azi", "dip"]


def rename_aliases(df: DataFrame) -> DataFrame:
    """Columns by their own names; a column that is there wins over its aliases, then the first alias of the list; losers go."""
    have, renames = set(df.columns), {}
    for alias, name in ALIASES.items():
        if alias in have and name not in have and name not in renames.values():
            renames[alias] = name
    return df.drop(*[a for a in ALIASES if a in have and a not in renames]).withColumnsRenamed(renames)


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """A channel sheet kept as text with a header, normalised; rows count in the order of the file."""
    rows = spark.read.option("header", True).csv(path).withColumn("_row", F.monotonically_increasing_id())
    missing = {"lat", "lon"} - set(rename_aliases(rows).columns)
    if missing:
        raise ValueError(f"channel columns missing: {sorted(missing)}")
    out = normalise_channels(rows, "_row").drop("_row")
    return out.withColumns({c: F.col(c).cast("double") for c in TRAILING})


def select_traces(traces: DataFrame, channels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Traces of the given rows of a channel catalog, by index_raw."""
    wanted = channels.select(*(keys or []), F.col("index_raw").alias("channel")).distinct()
    return traces.join(wanted, [*(keys or []), "channel"], "left_semi")


def _flag(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.when(text == "good", F.lit(1.0)).otherwise(F.lit(0.0)))


def normalise_channels(df: DataFrame, order: str, group: list[str] | None = None) -> DataFrame:
    """Channel catalog with all standard columns.

    fiber: 'n' by default, 'u' where null. taptest: 1 by default, text counts as
    1 if 'good'. quality: 1 by default, or 1 where spiky is 0; 0 where taptest is
    0. index_taptest: as supplied (null where taptest is 0), else 0, 1, ... of
    the located channels of each fiber in the order of ``order``. index_raw: as
    supplied, else the row's position.
    """
    df, group = rename_aliases(df), group or []
    have = set(df.columns)
    fiber = F.coalesce(F.col("fiber"), F.lit("u")) if "fiber" in have else F.lit("n")
    tap = _flag(F.col("taptest").cast("string")) if "taptest" in have else F.lit(1.0)
    out = df.withColumns({"fiber": fiber, "taptest": F.coalesce(tap, F.lit(1.0)).cast("tinyint")})
    if "quality" in have:
        quality = F.coalesce(F.col("quality").cast("string").try_cast("double"), F.lit(1.0))
    elif "spiky" in have:
        quality = F.when(F.col("spiky").cast("string").try_cast("double") == 0, 1.0).otherwise(0.0)
    else:
        quality = F.lit(1.0)
    out = out.withColumn("quality", F.when(F.col("taptest") == 0, 0.0).otherwise(quality).cast("tinyint")).drop("spiky")
    located = F.col("taptest") == 1
    if "index_taptest" in have:
        out = out.withColumn("index_taptest", F.when(located, F.col("index_taptest").cast("string").try_cast("double").cast("bigint")))
    else:
        w = Window.partitionBy(*group, "fiber", "taptest").orderBy(order)
        out = out.withColumn("index_taptest", F.when(located, F.row_number().over(w) - 1).cast("bigint"))
    if "index_raw" in have:
        out = out.withColumn("index_raw", F.col("index_raw").cast("bigint"))
    else:
        w = Window.partitionBy(*group).orderBy(order) if group else Window.orderBy(order)
        out = out.withColumn("index_raw", (F.row_number().over(w) - 1).cast("bigint"))
    for c in TRAILING:
        if c not in have:
            out = out.withColumn(c, F.lit(None).cast("double"))
    extras = [c for c in out.columns if c not in (*LEADING, *TRAILING)]
    return out.select(*LEADING, *extras, *TRAILING)


def by_fiber(df: DataFrame, fiber: str) -> DataFrame:
    return df.filter(F.col("fiber") == fiber)


def located(df: DataFrame) -> DataFrame:
    return df.filter("taptest = 1")


def active(df: DataFrame) -> DataFrame:
    return df.filter("taptest = 1 and quality = 1")


def origin(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean position of the located channels; without keys, none located is an error."""
    mean = located(df).groupBy(*(keys or [])).agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    none = F.raise_error(F.lit("no channel is located")).cast("double")
    return mean if keys else mean.select(F.coalesce("lat0", none).alias("lat0"), "lon0")


def summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Numbers of channels, located and active ones, and the fibers."""
    on = F.col("taptest") == 1
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if(on).alias("n_located"), F.count_if(on & (F.col("quality") == 1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("fiber")), ",").alias("fibers"))


def every_nth(df: DataFrame, n: int) -> DataFrame:
    """Every n-th located channel, for drawing."""
    return located(df).filter(F.col("index_taptest") % n == 0)


def with_coordinates(picks: DataFrame, channels: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Picks with their channel's lat and lon."""
    side = channels.select(*[F.col(c).alias(f"_c{i}") for i, (_, c) in enumerate(on)], "lat", "lon")
    cond = [picks[p] == F.col(f"_c{i}") for i, (p, _) in enumerate(on)]
    return picks.join(side, cond, "left").drop(*[f"_c{i}" for i in range(len(on))])
