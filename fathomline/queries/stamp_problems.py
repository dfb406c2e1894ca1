"""Problem 3: one UTC instant for each stamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attrs import attr_text
from ..functions.stamps import CANONICAL
from ..operators.stamps import AGAINST, paired_states, readings, settle, single_states
from ..session import table

START_NAME = r"(start|begin|beg)(time|timestamp|stamp)?|t0|firstsampletime"
CHUNK = 4096
WRITTEN_WITHIN_US = 24 * 60_000_000  # a file of 20 minutes at most, written 4 minutes later at most
SECOND_US = 1_000_000
MONTH_US = 30 * 86_400_000_000


def _zoned(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    zones = table(spark, sf, "das_arrays").select(F.col("array_id").alias("_array"), "tz")
    return df.join(zones, df["array_id"] == F.col("_array"), "left").drop("_array")


def _proc(spark: SparkSession, sf: str) -> DataFrame:
    """The start of every header."""
    rows = _zoned(spark, sf, table(spark, sf, "proc_headers").select("hdr_id", "run_id", "array_id", "file_no", F.unix_micros("written_at").alias("written"), attr_text(F.col("attrs"), START_NAME).alias("stamp")))
    rows = rows.withColumn("found", readings(F.col("stamp"), F.col("tz")))
    late = lambda us: F.col("written") - us
    states = single_states(F.col("found"), lambda us: F.when((late(us) < -SECOND_US) | (late(us) > WRITTEN_WITHIN_US + SECOND_US), F.lit(AGAINST)))
    return rows.select(F.col("hdr_id").alias("rec_id"), F.concat(F.lit("proc "), F.col("run_id")).alias("source"), F.floor(F.col("file_no") / CHUNK).alias("chunk"), F.col("file_no").cast("bigint").alias("at"), states.alias("states"), F.array(F.lit("proc"), "stamp").alias("keep"))


def _event(spark: SparkSession, sf: str) -> DataFrame:
    """begin_time and event_time of every event, in the order of extraction."""
    rows = _zoned(spark, sf, table(spark, sf, "event_headers").select("ev_id", "array_id", "begin_time", "event_time", "time_before", "event_time_index", "dt_s", F.unix_micros("extracted_at").alias("at")))
    rows = rows.withColumns({"b": readings(F.col("begin_time"), F.col("tz")), "e": readings(F.col("event_time"), F.col("tz"))})
    lead = F.coalesce("time_before", F.col("event_time_index") * F.col("dt_s")) * 1e6
    states = paired_states(F.col("b"), F.col("e"), lambda b, e: F.when(F.abs(e - b - lead) > 2 * SECOND_US, F.lit(AGAINST)))
    return rows.select(F.col("ev_id").alias("rec_id"), F.concat(F.lit("event "), F.col("array_id")).alias("source"), F.floor(F.col("at") / MONTH_US).alias("chunk"), "at", states.alias("states"), F.array(F.lit("event"), "begin_time", "event_time").alias("keep"))


def _stamps(spark: SparkSession, sf: str) -> DataFrame:
    """(src, rec_id, stamp_field, stamp, utc_us) of every stamp."""
    rows = _proc(spark, sf).unionByName(_event(spark, sf))
    chosen = settle(rows, "rec_id", F.col("source"), F.col("chunk"), F.col("at"), F.col("states"), F.col("keep"))
    field = lambda name, i: F.struct(F.lit(name).alias("stamp_field"), F.get("keep", F.lit(i + 1)).alias("stamp"), F.get("us", F.lit(i)).alias("utc_us"))
    fields = F.when(F.col("keep")[0] == "proc", F.array(field("startTime", 0))).otherwise(F.array(field("begin_time", 0), field("event_time", 1)))
    return chosen.select(F.col("keep")[0].alias("src"), "rec_id", F.inline(fields))


def p3_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Every stamp with its instant, null where it can't be read."""
    return _stamps(spark, sf)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stamps(spark, sf).filter(F.col("utc_us").isNotNull() & ~F.col("stamp").rlike(f"^{CANONICAL.pattern}$"))
    return rows.select("src", "rec_id", "stamp_field", "utc_us")


QUERIES = {f.__name__: f for f in (p3_found, p3_stamps)}
# the same by one pattern a form, and by the records' evidence alone, without a path
# fixed values: abbreviations of the clocks in these tables, in minutes
ABBREVIATED = "('UTC', 0), ('GMT', 0), ('Z', 0), ('CET', 60), ('CEST', 120), ('EET', 120), ('EEST', 180), ('EST', -300), ('EDT', -240), ('PST', -480), ('PDT', -420), ('NST', -210), ('NDT', -150), ('JST', 540), ('ACST', 570), ('ACDT', 630)"

SQL: dict[str, str] = {
    "p3_found": rf"""WITH abbr(zn, mins) AS (VALUES {ABBREVIATED}),
      ps AS (SELECT 'proc' AS src, hdr_id AS rec_id, 'startTime' AS field, array_id, coalesce(attrs ->> 'startTime', attrs ->> 'StartTime', attrs ->> 'begTime', attrs ->> 'begin_time') AS stamp FROM proc_headers),
      es AS (SELECT 'event' AS src, ev_id AS rec_id, unnest(['begin_time', 'event_time']) AS field, array_id, unnest([begin_time, event_time]) AS stamp FROM event_headers),
      st AS (SELECT u.*, trim(stamp) AS s, coalesce(tz, 'UTC') AS tz FROM (SELECT * FROM ps UNION ALL SELECT * FROM es) u LEFT JOIN das_arrays USING (array_id)),
      parts AS (SELECT *, rpad(left(regexp_extract(s, ':\d\d[.,](\d+)', 1), 6), 6, '0') AS frac, regexp_extract(s, '\d([+-]\d\d:?\d\d)(\[.*\])?$', 1) AS off, regexp_extract(s, ' ?(Z|[A-Z]{{2,5}})$', 1) AS zn,
        CASE WHEN regexp_matches(s, '^\d{{4}}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d') THEN try_strptime(replace(replace(left(s, 19), '/', '-'), 'T', ' '), '%Y-%m-%d %H:%M:%S')
          WHEN regexp_matches(s, '^\d{{4}}-\d{{3}}T') THEN try_strptime(left(s, 4) || '-01-01 ' || substr(s, 10, 8), '%Y-%m-%d %H:%M:%S') + to_days(CAST(substr(s, 6, 3) AS INT) - 1)
          WHEN regexp_matches(s, '^\d{{8}}T\d{{6}}') THEN try_strptime(left(s, 15), '%Y%m%dT%H%M%S')
          WHEN regexp_matches(s, '^\d\d\.\d\d\.\d{{4}} ') THEN try_strptime(left(s, 19), '%d.%m.%Y %H:%M:%S')
          WHEN regexp_matches(s, '^[A-Z][a-z]{{2}} \d') THEN try_strptime(s, '%b %d, %Y %I:%M:%S %p')
          WHEN regexp_matches(s, '^\d\d [A-Z][a-z]{{2}} \d{{4}}') THEN try_strptime(left(s, 20), '%d %b %Y %H:%M:%S') END AS naive FROM st),
      timed AS (SELECT *, epoch_us(naive) + coalesce(try_cast(nullif(frac, '000000') AS BIGINT), 0) AS wall FROM parts),
      fixed AS (SELECT t.*, CASE WHEN regexp_full_match(s, '\d+(\.\d+)?') THEN CASE length(regexp_extract(s, '^\d+')) WHEN 10 THEN CAST(trunc(CAST(s AS DECIMAL(30, 9)) * 1000000) AS BIGINT) WHEN 13 THEN CAST(left(s, 13) AS BIGINT) * 1000 WHEN 16 THEN CAST(left(s, 16) AS BIGINT) WHEN 19 THEN CAST(left(s, 16) AS BIGINT) END
          WHEN off <> '' THEN wall - (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS BIGINT) * 60 + CAST(right(off, 2) AS BIGINT)) * 60000000
          WHEN zn <> '' AND zn NOT IN ('AM', 'PM') THEN wall - CAST(mins AS BIGINT) * 60000000 END AS one FROM timed t LEFT JOIN abbr USING (zn)),
      near AS (SELECT *, CASE WHEN one IS NULL AND wall IS NOT NULL AND (zn = '' OR zn IN ('AM', 'PM')) THEN epoch_us(timezone(tz, make_timestamp(wall))) END AS c FROM fixed),
      cand AS (SELECT src, rec_id, field, stamp, tz, wall, unnest(CASE WHEN one IS NOT NULL THEN [one] ELSE [c, c - 3600000000, c + 3600000000] END) AS us, one FROM near),
      valid AS (SELECT src, rec_id, field, stamp, us FROM cand WHERE us IS NOT NULL AND (one IS NOT NULL OR epoch_us(timezone(tz, timezone('UTC', make_timestamp(us)))) = wall)),
      starts AS (SELECT v.src, rec_id, field, stamp, us, row_number() OVER (PARTITION BY rec_id ORDER BY CASE WHEN epoch_us(written_at) - us BETWEEN -1000000 AND 1441000000 THEN 0 ELSE 1 END, us) AS rk FROM valid v JOIN proc_headers ON hdr_id = rec_id WHERE v.src = 'proc'),
      other AS (SELECT v.*, w.us AS o, CASE WHEN v.field = 'begin_time' THEN w.us - v.us ELSE v.us - w.us END - coalesce(time_before, event_time_index * dt_s) * 1e6 AS d FROM valid v JOIN event_headers ON ev_id = v.rec_id LEFT JOIN valid w ON w.src = 'event' AND w.rec_id = v.rec_id AND w.field <> v.field WHERE v.src = 'event'),
      pairs AS (SELECT *, row_number() OVER (PARTITION BY rec_id, field ORDER BY CASE WHEN o IS NULL OR d IS NULL OR abs(d) <= 2000000 THEN 0 ELSE 1 END, us) AS rk FROM other)
      SELECT src, rec_id, field AS stamp_field, us AS utc_us FROM (SELECT src, rec_id, field, stamp, us, rk FROM starts UNION ALL SELECT src, rec_id, field, stamp, us, rk FROM pairs)
      WHERE rk = 1 AND NOT regexp_full_match(stamp, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{{6}}\+00:00')""",
}
