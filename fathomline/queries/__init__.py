"""Registered queries: name to callable(spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

from . import catalog_problems, drift_problems, reference, spike_problems, stamp_problems, unit_problems

MODULES = [catalog_problems, unit_problems, stamp_problems, drift_problems, spike_problems, reference]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
