"""Array columns worked on as matrices: one Arrow batch, rows of equal length at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

CELLS = 4_000_000  # values worked on at once


def with_params(x: Column, params: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(value, index, params)`` over an array, with ``params`` computed once per row.

    A lambda that refers to a column expression computes it anew for every
    element; here it is repeated by reference beside the values. Lambdas aren't
    nested either, as Spark can't hand nested ones to an Arrow kernel.
    """
    paired = F.zip_with(x, F.array_repeat(params, F.size(x)), lambda v, p: F.struct(v.alias("v"), p.alias("p")))
    return F.transform(paired, lambda s, i: body(s["v"], i, s["p"]))


def by_length(arrays: pd.Series, kernel: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """``kernel`` (rows, n) -> (rows, m) over all arrays; null stays null, an empty array stays empty."""
    out: list = [None if a is None else np.empty(0) for a in arrays]
    sizes = np.array([-1 if a is None else len(a) for a in arrays])
    for n in np.unique(sizes[sizes > 0]):
        rows = np.nonzero(sizes == n)[0]
        step = max(1, CELLS // int(n))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            for r, y in zip(part, kernel(np.stack([arrays.iloc[r] for r in part]).astype(np.float64)), strict=True):
                out[r] = y
    return pd.Series(out, dtype=object)


def row_kernel(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """An array column function from a matrix kernel; null elements come in as NaN."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(arrays: pd.Series) -> pd.Series:
        return by_length(arrays, kernel)

    return apply
