"""Implausible values of array-valued series, and grades off the scale their group follows.

Defined results: null arrays, null elements and empty arrays give no position;
series too short for a scatter, or with none, only have impossible and stuck
values; a group whose grades tie between the two scales follows 0 to 100.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import charts
from .ordered import fresh

CELLS = 4_000_000  # values worked on at once


def implausible_positions(samples: Column) -> Column:
    """0-based positions of implausible values in each array."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def positions(arrays: pd.Series) -> pd.Series:
        out: list = [[] for _ in range(len(arrays))]
        sizes = arrays.map(lambda a: 0 if a is None else len(a)).to_numpy()
        for n in np.unique(sizes[sizes > 0]):
            rows = np.nonzero(sizes == n)[0]
            step = max(1, CELLS // int(n))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                mask = charts.implausible(np.stack([arrays.iloc[r] for r in part]).astype(np.float64))
                at, pos = np.nonzero(mask)
                for r, p in zip(part, np.split(pos.astype(np.int32), np.cumsum(np.bincount(at, minlength=len(part)))[:-1]), strict=True):
                    out[r] = p
        return pd.Series(out, dtype=object)

    return F.filter(positions(samples), lambda p: F.get(samples, p).isNotNull())


def off_scale(df: DataFrame, group: str, grade: str) -> DataFrame:
    """Rows whose non-null grade lies off the scale of their group: 0/1, or 0 to 100.

    A group follows 0/1 if more than half of its grades within 0 to 100 are 0 or 1.
    Only two counts per group are shuffled; AQE splits a group that owns a large share of the rows.
    """
    g = F.col(grade)
    key, top = fresh(df, "group"), fresh(df, "top")
    graded = df.filter(g.isNotNull())
    flags, within = F.count_if(g.isin(0, 1)), F.count_if(g.between(0, 100))
    scales = graded.groupBy(F.col(group).alias(key)).agg(F.when(flags * 2 > within, 1).otherwise(100).alias(top))
    joined = graded.join(scales, graded[group].eqNullSafe(scales[key]))
    return joined.filter(~g.between(F.lit(0), F.col(top))).drop(key, top)
