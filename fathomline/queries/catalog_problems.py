"""Problems 1, 4 and 7: the catalog's coverage, its minute grid and its small files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical_path
from ..operators.compact import coded, compaction_plan, file_chunks, file_sizes, time_range, write_compacted
from ..operators.grid import counter_grid
from ..operators.intervals import coverage_gaps, coverage_periods
from ..operators.times import break_tolerance, resolve_times
from ..session import cut, ensure_checkpoint_dir, table

SMALL_SAMPLES = 2000
TARGET_SAMPLES = 1_000_000
ROWS_A_FILE = 100_000


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_times(table(spark, sf, "das_catalog"))


def _gaps(rows: DataFrame) -> DataFrame:
    return coverage_gaps(rows, "run_id", F.col("b_us"), F.col("e_us"), break_tolerance())


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(_catalog(spark, sf))


def p1_periods(spark: SparkSession, sf: str) -> DataFrame:
    return coverage_periods(_catalog(spark, sf), "run_id", F.col("b_us"), F.col("e_us"), break_tolerance())


def p4_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = _catalog(spark, sf)
    grid = counter_grid(rows, _gaps(rows), "run_id", canonical_path(F.col("file")), F.col("b_us"), F.col("rate"), F.col("first_sample"), F.col("n"))
    return grid.select("run_id", F.col("cell_no").alias("minute_no"), F.round("samples", 6).alias("samples"), F.round("lost", 6).alias("lost"), "uncovered_us", "status")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_grid(spark, sf).filter("status = 'empty'").select("run_id", "minute_no")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return file_chunks(_catalog(spark, sf), "row_id", canonical_path(F.col("file")), F.col("first_sample"), F.col("n"), F.col("array_id"), F.col("b_us"))


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    return coded(file_sizes(_chunks(spark, sf)), time_range(_catalog(spark, sf).filter("file is not null"), F.col("b_us")))


def p7_plan(spark: SparkSession, sf: str) -> DataFrame:
    return compaction_plan(_coded(spark, sf), TARGET_SAMPLES)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_plan(spark, sf).filter((F.col("samples") < SMALL_SAMPLES) & (F.col("piece_from") == 0)).select("first_row_id")


def p7_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every file as the plan holds it, put together from its pieces."""
    return p7_plan(spark, sf).groupBy("file").agg(F.min("first_row_id").alias("first_row_id"), F.sum("piece_samples").cast("bigint").alias("samples"), F.max("chunks").alias("chunks"))


def p7_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Planned output files: samples and pieces of each."""
    return p7_plan(spark, sf).groupBy("out_file").agg(F.sum("piece_samples").alias("samples"), F.count("*").alias("pieces"))


def p7_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and digests of the chunks as they are and as read again from the consolidated files, written in the order of the curve to the shared folder."""
    chunks = cut(_chunks(spark, sf).select("file", "first", "n"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/consolidated-{uuid.uuid4().hex}"
    done = write_compacted(chunks, compaction_plan(_coded(spark, sf), ROWS_A_FILE, "chunks"), path)
    rows = [(side, done["rows"], done[side]) for side in ("source", "written")]
    return spark.createDataFrame(rows, "side string, rows bigint, digest string")


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p4_found, p4_grid, p7_found, p7_plan, p7_files, p7_balance, p7_digest)}

RESOLVED = """
base AS (
  SELECT *, CASE WHEN epoch_us(begin_time) > 0 THEN epoch_us(begin_time) END AS b0,
    CASE WHEN epoch_us(end_time) > 0 THEN epoch_us(end_time) END AS e0,
    CASE WHEN fs > 0 AND NOT isnan(fs) THEN fs END AS r0, CASE WHEN nt > 0 THEN nt END AS n0
  FROM das_catalog),
rated AS (SELECT *, coalesce(r0, CASE WHEN n0 > 1 AND e0 > b0 THEN (n0 - 1) * 1e6 / (e0 - b0) END) AS rate FROM base),
counted AS (SELECT *, coalesce(n0, CASE WHEN e0 >= b0 THEN CAST(round_even((e0 - b0) * rate / 1e6, 0) AS BIGINT) + 1 END) AS n FROM rated),
resolved AS (
  SELECT *, coalesce(b0, e0 - CAST(round_even((n - 1) * 1e6 / rate, 0) AS BIGINT)) AS b_us,
    coalesce(e0, b0 + CAST(round_even((n - 1) * 1e6 / rate, 0) AS BIGINT)) AS e_us FROM counted)"""

GAPS = f"""{RESOLVED},
iv AS (SELECT DISTINCT run_id, b_us AS b, e_us AS e, coalesce(2.5e6 / rate, 0.0) AS tol FROM resolved WHERE run_id IS NOT NULL AND b_us IS NOT NULL AND e_us >= b_us),
run AS (SELECT *, max({{'e': e, 'tol': tol}}) OVER (PARTITION BY run_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM iv),
gaps AS (SELECT run_id, p.e AS gap_from_us, b AS gap_to_us FROM run WHERE b - p.e > p.tol)"""

PATHS = r"""
spelled AS (SELECT *, replace(regexp_replace(regexp_replace(file, '^\s+|\s+$', '', 'g'), '^file://', '', 'i'), '\', '/') AS f1 FROM resolved WHERE file IS NOT NULL),
decoded AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(url_decode(f1), '/'), lambda x: [x])),
  lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[:-2] ELSE list_concat(a, x) END) AS steps FROM spelled),
walked AS (SELECT *, '/' || array_to_string(steps, '/') AS f2 FROM decoded),
named AS (SELECT * EXCLUDE (file), regexp_replace(f2, '\.[A-Za-z0-9]*$', '') || lower(regexp_extract(f2, '\.[A-Za-z0-9]*$')) AS file FROM walked)"""

P7 = f"""{RESOLVED}, {PATHS},
chunk AS (SELECT file, coalesce(first_sample, 0) AS first, coalesce(max(n), 0) AS n, min(row_id) AS row_id FROM named GROUP BY ALL),
files AS (SELECT file, CAST(sum(n) AS BIGINT) AS samples, count(*) AS chunks, min(row_id) AS first_row_id FROM chunk GROUP BY file)"""

SQL = {
    "p1_found": f"WITH {GAPS} SELECT run_id, gap_from_us, gap_to_us FROM gaps",
    "p1_periods": f"""WITH {GAPS},
      opened AS (SELECT run_id, b, e, CASE WHEN p IS NULL OR b - p.e > p.tol THEN 1 ELSE 0 END AS o, row_number() OVER (PARTITION BY run_id ORDER BY b, e) AS i FROM run),
      numbered AS (SELECT run_id, b, e, sum(o) OVER (PARTITION BY run_id ORDER BY i) AS g FROM opened)
      SELECT run_id, min(b) AS period_from_us, max(e) AS period_to_us FROM numbered GROUP BY run_id, g""",
    "p4_found": f"""WITH {GAPS},
      spans AS (SELECT run_id, gap_from_us // 60000000 + 1 AS lo, gap_to_us // 60000000 - 1 AS hi FROM gaps)
      SELECT run_id, unnest(range(lo, hi + 1)) AS minute_no FROM spans
      UNION ALL SELECT run_id, gap_from_us // 60000000 FROM gaps WHERE FALSE""",
    "p7_files": f"WITH {P7} SELECT file, first_row_id, samples, chunks FROM files",
    "p7_digest": f"""WITH {P7}, d AS (SELECT count(*) AS rows, CAST(coalesce(sum(CAST(('0x' || substr(md5(file || '|' || first || '|' || n), 1, 15)) AS BIGINT)), 0) AS VARCHAR) AS digest FROM chunk)
      SELECT 'source' AS side, rows, digest FROM d UNION ALL SELECT 'written', rows, digest FROM d""",
    "p7_found": f"WITH {P7} SELECT first_row_id FROM files WHERE samples < 2000",
    "p4_grid": f"""WITH {GAPS}, {PATHS},
      ch AS (SELECT run_id, file, coalesce(first_sample, 0) AS c0, b_us AS b, max({{'n': n, 'r': rate}}) AS m FROM (SELECT * FROM named UNION ALL BY NAME SELECT * FROM resolved WHERE file IS NULL) WHERE run_id IS NOT NULL AND b_us IS NOT NULL AND rate > 0 AND n > 0 GROUP BY ALL),
      st AS (SELECT run_id, file, c0, b, m.n AS n, b + CAST(round_even(m.n * (1e6 / m.r), 0) AS BIGINT) AS t1, b + CAST(round_even((m.n - 1) * (1e6 / m.r), 0) AS BIGINT) AS last FROM ch),
      pv AS (SELECT *, lag(t1) OVER w AS pt, c0 - lag(c0 + n) OVER w AS jump FROM st WINDOW w AS (PARTITION BY run_id, file ORDER BY b, c0)),
      parts AS (SELECT run_id, b AS t0, t1, last, CAST(n AS DOUBLE) AS inc, 1 AS seen FROM pv UNION ALL SELECT run_id, pt, b, b - 1, CAST(jump AS DOUBLE), 0 FROM pv WHERE jump > 0 AND b > pt),
      cells AS (SELECT *, unnest(range(t0 // 60000000, last // 60000000 + 1)) AS m FROM parts),
      shares AS (SELECT run_id, m, inc * (CASE WHEN m = last // 60000000 THEN t1 ELSE (m + 1) * 60000000 END - greatest(t0, m * 60000000)) / (t1 - t0) AS share, seen, 0 AS u FROM cells),
      holes AS (SELECT *, unnest(range(gap_from_us // 60000000, (gap_to_us - 1) // 60000000 + 1)) AS m FROM gaps),
      every AS (SELECT run_id, m, CASE WHEN seen = 1 THEN share ELSE 0 END AS s, CASE WHEN seen = 1 THEN 0 ELSE share END AS l, seen, u FROM shares
        UNION ALL SELECT run_id, m, 0, 0, 0, least(gap_to_us, (m + 1) * 60000000) - greatest(gap_from_us, m * 60000000) FROM holes)
      SELECT run_id, m AS minute_no, round(sum(s), 6) AS samples, round(sum(l), 6) AS lost, CAST(sum(u) AS BIGINT) AS uncovered_us, CASE WHEN max(seen) = 0 THEN 'empty' WHEN sum(u) > 0 THEN 'partial' ELSE 'full' END AS status FROM every GROUP BY run_id, m""",
}
