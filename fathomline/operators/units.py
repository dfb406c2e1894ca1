"""Values in mixed units, converted to microstrain, microstrain/s and metres.

The unit of a record is the one its unit field holds; where that is blank, the
one its own texts state. Each distinct text is parsed once per Arrow batch by
the grammar in ``functions.units``; scales and exponent vectors come back as a
struct, and the values are converted on the JVM side.

Defined results: a unit that is neither stated nor readable gives a null unit
and null values; counts and phase need the record's factor to strain and are
null without it; null values stay null; texts of any length are read whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import units as U
from .ordered import fresh

UNIT = StructType([StructField("name", StringType()), StructField("scale", DoubleType()), StructField("offset", DoubleType()), StructField("dims", ArrayType(IntegerType()))])


def _frame(found: list) -> pd.DataFrame:
    return pd.DataFrame({"name": [u and U.name_of(u) for u in found], "scale": [u.scale if u else None for u in found], "offset": [u.offset if u else None for u in found], "dims": [list(u.dims) if u else None for u in found]})


def _once(read):
    """The function as one that Spark must not repeat: else a filter on what it gives is pushed below it, with a second call."""
    return read.asNondeterministic()


def signal_unit(field: Column, texts: Column) -> Column:
    """The unit struct of a signal's unit field, or else of the first text (of an array) that states one."""

    @F.pandas_udf(UNIT)
    def read(units: pd.Series, notes: pd.Series) -> pd.DataFrame:
        found = []
        for u, ts in zip(units, notes, strict=True):
            if U.stated(u):
                got = U.unit_of(u)
                found.append(got if got and U.is_signal(got) else None)
            else:
                found.append(next((x for t in (ts if ts is not None else ()) if (x := U.signal_unit_in(t))), None))
        return _frame(found)

    return _once(read)(field, texts)


def length_unit(note: Column) -> Column:
    """The unit struct that a note states for a length; metres where it states none."""

    @F.pandas_udf(UNIT)
    def read(notes: pd.Series) -> pd.DataFrame:
        return _frame([U.length_unit_in(n) or U.symbol("m") for n in notes])

    return _once(read)(note)


def canonical_unit(unit: Column) -> Column:
    """microstrain, microstrain/s or m, by the unit's exponents."""
    second = F.element_at(unit["dims"], 2)
    return F.when(F.element_at(unit["dims"], 5) == 1, "K").when(F.element_at(unit["dims"], 1) == 1, "m").when(second == -1, "microstrain/s").when(second == 0, "microstrain")


def canonical_factor(unit: Column, to_strain: Column) -> Column:
    """What a value in ``unit`` is multiplied by (before its offset is added) to be in its canonical unit; ``to_strain`` serves counts and phase."""
    physical = (F.element_at(unit["dims"], 3) != 0) | (F.element_at(unit["dims"], 4) != 0)
    base = (F.element_at(unit["dims"], 1) == 1) | (F.element_at(unit["dims"], 5) == 1)
    return F.when(base, unit["scale"]).otherwise(unit["scale"] * 1e6 * F.when(physical, to_strain).otherwise(F.lit(1.0)))


def quantities(text: Column) -> Column:
    """struct<value, name, scale, offset, dims> of texts that hold a number and a unit; the value is in base units."""

    @F.pandas_udf(StructType([StructField("value", DoubleType()), *UNIT.fields]))
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [U.quantity_of(t) for t in texts]
        return pd.concat([pd.DataFrame({"value": [q and q[0] for q in found]}, dtype=float), _frame([q and q[1] for q in found])], axis=1)

    return _once(read)(text)


def with_units(df: DataFrame, unit: Column, to_strain: Column) -> DataFrame:
    """Adds unit_name (its plain name), canonical_unit, factor and offset (canonical = value * factor + offset); columns of these names are replaced."""
    name = fresh(df, "unit")
    out = df.withColumn(name, unit)
    u = F.col(name)
    return out.withColumns({"unit_name": u["name"], "canonical_unit": canonical_unit(u), "factor": canonical_factor(u, to_strain), "offset": u["offset"]}).drop(name)
