"""Problem 6: values that cannot be right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spikes import implausible_positions, off_scale
from ..session import table


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    traces = table(spark, sf, "das_traces").select("trace_id", F.explode(implausible_positions(F.col("samples"))).alias("pos"))
    grades = off_scale(table(spark, sf, "das_channels").select("chan_id", "run_id", "quality"), "run_id", "quality")
    return traces.select(F.lit("trace").alias("src"), F.col("trace_id").alias("rec_id"), "pos").unionByName(grades.select(F.lit("quality").alias("src"), F.col("chan_id").alias("rec_id"), F.lit(-1).alias("pos")))


def p6_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Every trace with its implausible values as nulls, and how many there are."""
    rows = table(spark, sf, "das_traces").select("trace_id", "samples", implausible_positions(F.col("samples")).alias("bad"))
    return rows.select("trace_id", F.size("bad").alias("n_bad"), F.transform("samples", lambda x, i: F.when(~F.array_contains("bad", i), x)).alias("samples"))


QUERIES = {f.__name__: f for f in (p6_found, p6_cleaned)}
# the same by the statement alone, without a chart: every stretch of one to three samples against the samples beside it
STRETCHES = [(length, at) for length in (1, 2, 3) for at in range(length)]  # of a stretch of this length, the sample is number ``at``


def _stretch(length: int, at: int) -> str:
    """Whether the sample lies in a stretch, as its number ``at``, that lies beyond ten times the scatter from both samples beside it."""
    cell = lambda k: "x" if k == 0 else f"lag(x, {-k}) OVER w" if k < 0 else f"lead(x, {k}) OVER w"
    inside = [cell(k - at) for k in range(length)]
    before, after = cell(-1 - at), cell(length - at)
    whole = " AND ".join(f"{c} IS NOT NULL" for c in inside)
    low, high = f"least({', '.join(inside)})", f"greatest({', '.join(inside)})"
    far = f"({low} - coalesce({before}, {after}) > 10 * sc AND {low} - coalesce({after}, {before}) > 10 * sc) OR (coalesce({before}, {after}) - {high} > 10 * sc AND coalesce({after}, {before}) - {high} > 10 * sc)"
    return f"({whole} AND ({far}))"


SQL: dict[str, str] = {
    "p6_found": f"""WITH s AS (SELECT trace_id, unnest(range(len(samples))) AS pos, CAST(unnest(samples) AS DOUBLE) AS x FROM das_traces WHERE len(samples) > 0),
      i AS (SELECT *, coalesce(isnan(x) OR isinf(x) OR abs(x) >= 1e12, FALSE) AS impossible, x IS NULL OR isnan(x) AS gone, lag(x) OVER (PARTITION BY trace_id ORDER BY pos) AS was FROM s),
      g AS (SELECT *, sum(CASE WHEN was = x AND NOT gone AND NOT isnan(was) THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY pos) AS run_no FROM i),
      r AS (SELECT *, NOT gone AND NOT impossible AND count(*) OVER (PARTITION BY trace_id, run_no) >= 10 AS stuck FROM g),
      y AS (SELECT trace_id, pos, x FROM r WHERE NOT gone AND NOT impossible AND NOT stuck),
      d AS (SELECT *, x - lag(x) OVER w AS step, pos - lag(pos) OVER w AS apart FROM y WINDOW w AS (PARTITION BY trace_id ORDER BY pos)),
      m AS (SELECT trace_id, median(step) AS md FROM d WHERE apart = 1 GROUP BY trace_id),
      sc AS (SELECT d.trace_id, 1.4826 * median(abs(step - md)) AS sc FROM d JOIN m USING (trace_id) WHERE apart = 1 GROUP BY d.trace_id),
      spikes AS (SELECT y.trace_id, pos, {" OR ".join(_stretch(*x) for x in STRETCHES)} AS spike FROM y JOIN sc ON y.trace_id = sc.trace_id AND sc > 0 WINDOW w AS (PARTITION BY y.trace_id ORDER BY pos)),
      scales AS (SELECT run_id, CASE WHEN count(*) FILTER (quality IN (0, 1)) * 2 > count(*) FILTER (quality BETWEEN 0 AND 100) THEN 1 ELSE 100 END AS top FROM das_channels WHERE quality IS NOT NULL GROUP BY run_id)
      SELECT 'trace' AS src, trace_id AS rec_id, CAST(pos AS INT) AS pos FROM r WHERE impossible OR stuck UNION ALL SELECT 'trace', trace_id, CAST(pos AS INT) FROM spikes WHERE spike
      UNION ALL SELECT 'quality', chan_id, -1 FROM das_channels c JOIN scales s ON c.run_id IS NOT DISTINCT FROM s.run_id WHERE quality IS NOT NULL AND (quality < 0 OR quality > top)""",
}
