"""Time-axis operators on a channel's samples (array<double>), one row per channel.

Stateless ones are higher-order functions and stay in the JVM; running ones
(integration, unwrapping, moving means) are Arrow kernels. None of them
shuffles: a channel's samples travel as one array.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import row_kernel, with_params


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def detrend(x: Column) -> Column:
    """Less the least-squares line over the sample index; a single sample becomes 0."""
    y, n = doubles(x), F.size(x).cast("double")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(0.0).alias("i"))
    sums = F.aggregate(y, zero, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["w"] + a["i"] * v).alias("w"), (a["i"] + 1.0).alias("i")))
    fit = F.struct(sums.alias("t"), n.alias("n"))

    def less(v: Column, i: Column, p: Column) -> Column:
        n, middle = p["n"], (p["n"] - 1) / 2
        slope = F.coalesce(F.try_divide(p["t"]["w"] - middle * p["t"]["s"], n * (n * n - 1) / 12), F.lit(0.0))
        return v - (F.try_divide(p["t"]["s"], n) + slope * (i - middle))

    return with_params(y, fit, less)


def tukey(i: Column, n: Column, alpha: float) -> Column:
    """Weight i of a symmetric Tukey window of n samples."""
    if alpha <= 0:
        return F.lit(1.0)
    a, last = min(alpha, 1.0), n - 1
    ramp = F.floor(F.lit(a) * last / 2)
    rise = 0.5 * (1 + F.cos(F.lit(math.pi) * (-1 + 2.0 * i / (F.lit(a) * last))))
    fall = 0.5 * (1 + F.cos(F.lit(math.pi) * (-2.0 / a + 1 + 2.0 * i / (F.lit(a) * last))))
    return F.when(n < 2, F.lit(1.0)).when(i <= ramp, rise).when(i >= n - ramp - 1, fall).otherwise(1.0)


def taper(x: Column, alpha: float = 0.4) -> Column:
    return with_params(doubles(x), F.size(x), lambda v, i, n: v * tukey(i, n, alpha))


def backward_difference(x: Column, dt: Column) -> Column:
    """(x[i] - x[i-1]) / dt, and 0 for the first sample."""
    y = doubles(x)
    before = F.concat(F.slice(y, 1, 1), y)
    return with_params(F.slice(F.zip_with(y, before, lambda v, u: v - u), F.lit(1), F.size(x)), dt, lambda d, _, dt: d / dt)


def gradient(x: Column, dt: Column) -> Column:
    """Central difference, one-sided at both ends; null for fewer than two samples."""
    y, n = doubles(x), F.size(x)
    behind, ahead = F.concat(F.slice(y, 1, 1), y), F.concat(F.slice(y, 2, 2_147_483_645), F.slice(y, -1, 1))
    steps = F.slice(F.zip_with(ahead, behind, lambda b, a: b - a), F.lit(1), n)
    params = F.struct(n.alias("n"), dt.alias("dt"))
    return F.when(n >= 2, with_params(steps, params, lambda d, i, p: d / (F.when((i == 0) | (i == p["n"] - 1), F.lit(1.0)).otherwise(2.0) * p["dt"])))


def integrate(dt: float):
    """Running sum times dt, with the first sample at 0 (its value counts from the second on)."""

    def kernel(x: np.ndarray) -> np.ndarray:
        y = np.cumsum(x, axis=1) * dt
        y[:, 0] = 0.0
        return y

    return row_kernel(kernel)


def unwrap(factor: float = 1.0):
    """Counts without their roll-over of 2**32 * factor; at most one roll-over a step, jumps of exactly half stay."""
    wrap = 2.0**32 * factor

    def kernel(x: np.ndarray) -> np.ndarray:
        # the jump between unwrapped neighbours is the raw jump, as the offset so far is in both
        d = np.diff(x, axis=1)
        turns = np.where(d > wrap / 2, -wrap, np.where(d < -wrap / 2, wrap, 0.0))
        y = x.copy()
        y[:, 1:] += np.cumsum(turns, axis=1)
        return y

    return row_kernel(kernel)


def one_bit(x: Column) -> Column:
    return F.transform(x, lambda v: F.signum(v.cast("double")))


def running_abs_mean(window: int):
    """Over the moving mean of absolute values (edges repeated), 0 where that is 0."""
    before, after = window // 2, window - 1 - window // 2

    def kernel(x: np.ndarray) -> np.ndarray:
        a = np.pad(np.abs(x), ((0, 0), (before, after)), mode="edge")
        c = np.cumsum(np.pad(a, ((0, 0), (1, 0))), axis=1)
        env = (c[:, window:] - c[:, :-window]) / window
        return np.divide(x, env, out=np.zeros_like(x), where=env > 0)

    return row_kernel(kernel)


def stride(x: Column, step: int) -> Column:
    return x if step <= 1 else F.filter(x, lambda _, i: i % step == 0)


def window_slice(x: Column, start: Column, stop: Column) -> Column:
    """Samples [start, stop), with both cut to the array; a window outside gives none."""
    lo = F.greatest(start, F.lit(0))
    n = F.greatest(F.least(stop, F.size(x)) - lo, F.lit(0))
    return F.slice(x, (lo + 1).cast("int"), n.cast("int"))


def peak_scaled(x: Column) -> Column:
    """Over the channel's peak amplitude (1e-30 at least)."""
    y = doubles(x)
    return with_params(y, F.greatest(F.array_max(F.transform(y, F.abs)), F.lit(1e-30)), lambda v, _, peak: v / peak)
