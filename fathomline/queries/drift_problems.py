"""Problem 5: schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attrs import attr_texts
from ..operators.drift import attr_versions, cell_versions, changes_of, column_families, column_types, others, unified, version_changes
from ..session import table


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    return attr_versions(table(spark, sf, "proc_headers"), "run_id", "file_no", "hdr_id", "file", "attrs")


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    return cell_versions(table(spark, sf, "sheet_rows"), "run_id", "sheet_no", "sheet_file", "row_no", "cells")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    changes = version_changes(_headers(spark, sf).unionByName(_sheets(spark, sf)))
    return changes.select(F.col("kind").alias("src"), "file", "change_kind", "old_name", "new_name")


def _unified(rows: DataFrame, values: str, keys: list[str], versions: DataFrame) -> DataFrame:
    """The keys, one column a family of names, typed, and what a family's column can't hold."""
    families = column_families(*changes_of(versions))
    types = column_types(rows.select(values), families)
    taken, names = {"others", *(k.lower() for k in keys)}, {}
    for f in types:  # a family may be called like a key, or differ from another by its case only
        n = f
        while n.lower() in taken:
            n += "_value"
        taken.add(n.lower())
        names[f] = n
    cols = unified(F.col(values), families, types)
    return rows.select(*keys, *[c.alias(names[f]) for c, f in zip(cols, types, strict=True)], F.to_json(others(F.col(values), families)).alias("others"))


def p5_headers(spark: SparkSession, sf: str) -> DataFrame:
    """All headers in one table, whatever their attributes were called; lists of one element are opened."""
    return _unified(table(spark, sf, "proc_headers").withColumn("_values", attr_texts(F.col("attrs"))), "_values", ["hdr_id", "run_id", "file", "file_no"], _headers(spark, sf))


def p5_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """All sheets' rows in one table, whatever their columns were called."""
    return _unified(table(spark, sf, "sheet_rows"), "cells", ["sheet_row_id", "run_id", "sheet_file", "sheet_no", "row_no"], _sheets(spark, sf))


QUERIES = {f.__name__: f for f in (p5_found, p5_headers, p5_sheets)}
# the same by a list of which names belong together, as the files of this project use them
FAMILIES = {
    "nCh": ["nCh", "NumChannels", "nChannels", "n_channels", "nx"], "nt": ["nt", "nSamples"], "fs": ["fs", "Fs", "sampling_rate"], "dCh": ["dCh", "dx", "dx_m", "ChannelSpacing"], "startTime": ["startTime", "StartTime", "begTime", "begin_time"],
    "endTime": ["endTime", "EndTime", "end_time", "stopTime"], "GaugeLength": ["GaugeLength", "GaugeLen", "gauge_length_m"], "index_raw": ["index_raw", "index", "ichan_before_taptest"], "index_taptest": ["index_taptest", "ichan_after_taptest", "taptest_channel_index"],
    "lat": ["lat", "latitude"], "lon": ["lon", "longitude"], "ele": ["ele", "elevation"], "azi": ["azi", "azimuth"], "dip": ["dip", "dipping angle"], "taptest": ["taptest", "status"],
}
KNOWN = ", ".join(f"('{n}', '{f}')" for f, ns in FAMILIES.items() for n in ns)
LONE = {"dt": "DOUBLE", "nodeTemp": "DOUBLE", "polarity": "BIGINT", "pulseRate": "BIGINT", "firmware": "VARCHAR", "chain": "VARCHAR"}
HEADER_TYPES = {"nCh": "DOUBLE", "nt": "BIGINT", "fs": "DOUBLE", "dCh": "DOUBLE", "startTime": "VARCHAR", "endTime": "VARCHAR", "GaugeLength": "DOUBLE"} | LONE
SHEET_TYPES = {"index_raw": "BIGINT", "fiber": "VARCHAR", "taptest": "VARCHAR", "quality": "VARCHAR", "index_taptest": "DOUBLE", "lat": "DOUBLE", "lon": "DOUBLE", "ele": "DOUBLE", "azi": "DOUBLE", "dip": "DOUBLE", "splice": "VARCHAR", "remark": "VARCHAR", "gain": "BIGINT"}


def _columns(types: dict[str, str], value: str) -> str:
    """One typed column a family; ``value`` is the text under the name {n}."""

    def column(family: str, kind: str) -> str:
        names = [family, *sorted(n for n in FAMILIES.get(family, []) if n != family)]
        found = "coalesce(" + ", ".join(f"CASE WHEN trim({v}) <> '' THEN {v} END" for n in names for v in [value.format(n=n)]) + ")"
        return f'{found} AS "{family}"' if kind == "VARCHAR" else f"""CAST(regexp_replace(trim({found}), '^[A-Za-z]+[-_ ]?([0-9]+)$', '\\1') AS {kind}) AS "{family}\""""

    return ", ".join(column(f, k) for f, k in types.items())


OPENED = """regexp_replace(attrs ->> '$."{n}"', '^\\["?([^",]*)"?\\]$', '\\1')"""

SQL: dict[str, str] = {
    "p5_found": f"""WITH known(name, fam) AS (VALUES {KNOWN}),
      pf AS (SELECT run_id, file_no AS no, arg_min(file, hdr_id) AS file, arg_min(attrs, hdr_id) AS a FROM proc_headers WHERE run_id IS NOT NULL AND file_no IS NOT NULL GROUP BY ALL),
      pa AS (SELECT run_id, no, unnest(json_keys(a)) AS k, a FROM pf),
      pt AS (SELECT 'proc' AS src, run_id, no, k, CASE WHEN trim(a ->> ('$."' || k || '"')) <> '' THEN json_type(a, '$."' || k || '"') END AS jt FROM pa),
      sc AS (SELECT run_id, sheet_no AS no, sheet_file AS file, unnest(map_keys(cells)) AS k, trim(unnest(map_values(cells))) AS v FROM sheet_rows WHERE run_id IS NOT NULL AND sheet_no IS NOT NULL),
      st AS (SELECT 'sheet' AS src, run_id, no, k, max(CASE WHEN v = '' OR v IS NULL THEN NULL WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 1 WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 2 ELSE 3 END) AS rk FROM sc GROUP BY ALL),
      cols AS (SELECT src, run_id, no, k, CASE WHEN jt IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN jt = 'DOUBLE' THEN 'fractional' WHEN jt = 'VARCHAR' THEN 'text' WHEN jt = 'ARRAY' THEN 'list' END AS kind FROM pt
        UNION ALL SELECT src, run_id, no, k, CASE rk WHEN 1 THEN 'integer' WHEN 2 THEN 'fractional' WHEN 3 THEN 'text' END FROM st),
      fam AS (SELECT cols.*, coalesce(known.fam, k) AS fam FROM cols LEFT JOIN known ON known.name = k),
      files AS (SELECT 'proc' AS src, run_id, no, file FROM pf UNION ALL SELECT DISTINCT 'sheet', run_id, no, file FROM sc),
      steps AS (SELECT *, lag(no) OVER (PARTITION BY src, run_id ORDER BY no) AS was FROM files),
      now AS (SELECT s.src, s.run_id, s.no, s.file, f.fam, f.k, f.kind FROM steps s JOIN fam f ON f.src = s.src AND f.run_id = s.run_id AND f.no = s.no WHERE was IS NOT NULL),
      old AS (SELECT s.src, s.run_id, s.no, s.file, f.fam, f.k, f.kind FROM steps s JOIN fam f ON f.src = s.src AND f.run_id = s.run_id AND f.no = s.was),
      both_sides AS (SELECT coalesce(now.src, old.src) AS src, coalesce(now.file, old.file) AS file, old.k AS o, now.k AS n, old.kind AS ok, now.kind AS nk FROM now FULL JOIN old ON now.src = old.src AND now.run_id = old.run_id AND now.no = old.no AND now.fam = old.fam)
      SELECT src, file, 'added' AS change_kind, '' AS old_name, n AS new_name FROM both_sides WHERE o IS NULL UNION ALL SELECT src, file, 'removed', o, '' FROM both_sides WHERE n IS NULL
      UNION ALL SELECT src, file, 'renamed', o, n FROM both_sides WHERE o <> n UNION ALL SELECT src, file, 'retyped', o, n FROM both_sides WHERE ok <> nk""",
    "p5_headers": f"SELECT hdr_id, run_id, file, file_no, {_columns(HEADER_TYPES, OPENED)}, CASE WHEN attrs IS NOT NULL THEN '{{}}' END AS others FROM proc_headers",
    "p5_sheets": f"SELECT sheet_row_id, run_id, sheet_file, sheet_no, row_no, {_columns(SHEET_TYPES, "cells['{n}']")}, CASE WHEN cells IS NOT NULL THEN '{{}}' END AS others FROM sheet_rows",
}
