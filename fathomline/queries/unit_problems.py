"""Problem 2: one quantity in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import length_unit, signal_unit, with_units
from ..session import table

CANONICAL = ("microstrain", "microstrain/s", "m")


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.map_entries("raw_meta")), lambda e: e["value"])
    return with_units(table(spark, sf, "das_traces"), signal_unit(F.col("units"), texts), F.col("physical_factor"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return with_units(table(spark, sf, "event_headers"), signal_unit(F.col("unit"), F.array("remark")), F.lit(None).cast("double"))


def _gauges(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "das_catalog").filter("gauge_length_m is not null")
    return with_units(rows, length_unit(F.col("gauge_note")), F.lit(None).cast("double"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = ((_traces, "trace", "trace_id"), (_events, "event", "ev_id"), (_gauges, "gauge", "row_id"))
    found = [f(spark, sf).select(F.lit(src).alias("src"), F.col(rec).alias("rec_id"), F.col("unit_name").alias("unit")).filter(~F.col("unit").isin(*CANONICAL)) for f, src, rec in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p2_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Every trace with its samples in microstrain or microstrain/s."""
    return _traces(spark, sf).select("trace_id", "unit_name", "canonical_unit", F.transform("samples", lambda x: x.cast("double") * F.col("factor") + F.col("offset")).alias("samples"))


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every event amplitude and gauge length in its canonical unit."""
    events = _events(spark, sf).select(F.lit("event").alias("src"), F.col("ev_id").alias("rec_id"), "unit_name", "canonical_unit", F.round(F.col("peak_amp") * F.col("factor") + F.col("offset"), 9).alias("value"))
    gauges = _gauges(spark, sf).select(F.lit("gauge").alias("src"), F.col("row_id").alias("rec_id"), "unit_name", "canonical_unit", F.round(F.col("gauge_length_m") * F.col("factor") + F.col("offset"), 9).alias("value"))
    return events.unionByName(gauges)


QUERIES = {f.__name__: f for f in (p2_found, p2_traces, p2_values)}
# the same by patterns: what a unit text says of kind, scale and rate
NAMED = """named AS (SELECT *, CASE WHEN regexp_matches(t, '(^|[^a-z])(counts?|cts)($|[^a-z])') THEN 'count' WHEN regexp_matches(t, 'rad') THEN 'radian' WHEN regexp_matches(t, 'strain|ε|m/m') THEN 'strain' END AS kind,
    CASE WHEN regexp_matches(t, '^n(ano)?[- ]?(strain|ε|m/m)|^1e-9|^10\\^-9') THEN 'nano' WHEN regexp_matches(t, '^(u|µ|μ|micro)[- ]?(strain|ε|m/m)|^1e-6|^10\\^-6') THEN 'micro' ELSE '' END AS scale,
    CASE WHEN regexp_matches(t, '/s(ec)?$|per second$|s\\^-1$') THEN '/s' ELSE '' END AS rate FROM texts)""".replace("\\\\", "\\")

SAID = r"""regexp_extract({t}, '(?:stored as|unit:|unit=|values are|payload in) *(.*?)(?:;|, spacing| after export|$)', 1)"""
BLANK = "coalesce(lower(trim({u})), '') IN ('', '-', 'n/a', 'unknown')"
BRACKET = r"""regexp_extract({t}, '^\[(.*)\] v', 1)"""


def _said(t: str) -> str:
    return f"coalesce(nullif({SAID.format(t=t)}, ''), nullif({BRACKET.format(t=t)}, ''))"


SIGNALS = f"""trace_notes AS (SELECT trace_id, max({_said("v")}) AS said FROM (SELECT trace_id, unnest(map_values(raw_meta)) AS v FROM das_traces) GROUP BY trace_id),
texts AS (SELECT 'trace' AS src, trace_id AS rec_id, CASE WHEN {BLANK.format(u="units")} THEN lower(said) ELSE lower(trim(units)) END AS t, NULL::DOUBLE AS v FROM das_traces LEFT JOIN trace_notes USING (trace_id)
  UNION ALL SELECT 'event', ev_id, CASE WHEN {BLANK.format(u="unit")} THEN lower({_said("remark")}) ELSE lower(trim(unit)) END, peak_amp FROM event_headers),
{NAMED},
notes AS (SELECT row_id, gauge_length_m, lower(trim(regexp_replace(string_split(coalesce(gauge_note, ''), ',')[1], '\\(.*\\)|;.*', '', 'g'))) AS n FROM das_catalog WHERE gauge_length_m IS NOT NULL),
gauge AS (SELECT row_id, gauge_length_m, CASE WHEN regexp_matches(n, '^splice|^re-term') THEN 'm' WHEN regexp_matches(n, '(^|[^a-z])(ft|foot|feet)($|[^a-z])') THEN 'ft' WHEN regexp_matches(n, '(^|[^a-z])(mm|millimet)') THEN 'mm' WHEN regexp_matches(n, '(^|[^a-z])(cm|centimet)') THEN 'cm'
  WHEN regexp_matches(n, '^in$|[0-9] in$|inch') THEN 'in' ELSE 'm' END AS unit FROM notes)""".replace("\\\\", "\\")

SQL: dict[str, str] = {
    "p2_found": f"""WITH {SIGNALS}, found AS (SELECT src, rec_id, scale || kind || rate AS unit FROM named WHERE kind IS NOT NULL UNION ALL SELECT 'gauge', row_id, unit FROM gauge)
      SELECT * FROM found WHERE unit NOT IN ('microstrain', 'microstrain/s', 'm')""",
    "p2_values": f"""WITH {SIGNALS} SELECT src, rec_id, scale || kind || rate AS unit_name, CASE WHEN kind IS NOT NULL THEN 'microstrain' || rate END AS canonical_unit,
      round(CASE WHEN kind = 'strain' THEN v * CASE scale WHEN 'nano' THEN 1e-3 WHEN 'micro' THEN 1.0 ELSE 1e6 END END, 9) AS value FROM named WHERE src = 'event'
      UNION ALL SELECT 'gauge', row_id, unit, 'm', round(gauge_length_m * CASE unit WHEN 'ft' THEN 0.3048 WHEN 'in' THEN 0.0254 WHEN 'cm' THEN 0.01 WHEN 'mm' THEN 0.001 ELSE 1.0 END, 9) FROM gauge""",
}
