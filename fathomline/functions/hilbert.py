"""Hilbert codes of points in several dimensions (Skilling's transpose form, 2004)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def hilbert_codes(points: np.ndarray, bits: int) -> np.ndarray:
    """Codes of integer points, one row each; every coordinate has ``bits`` bits."""
    x = points.astype(np.int64).T.copy()
    dims = x.shape[0]
    top = np.int64(1) << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            code = (code << 1) | ((x[i] >> b) & 1)
    return code


def hilbert(bits: int, *coords: Column) -> Column:
    """Hilbert code of integer columns in [0, 2**bits); bits times columns is 63 at most. Null counts as 0."""
    if bits * len(coords) > 63:
        raise ValueError("the code must fit into a bigint")

    @F.pandas_udf(LongType())
    def code(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_codes(np.clip(cols.to_numpy(dtype=np.int64), 0, (1 << bits) - 1), bits))

    return code(F.struct(*[F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"c{i}") for i, c in enumerate(coords)]))
