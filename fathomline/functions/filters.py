"""Butterworth filters as cascades of second-order sections (bilinear transform).

``f`` is the corner in cycles per sample. A zero-phase filter runs forward and
backward with half the poles (rounded up) each way, from rest at both ends, so
its gain at the corner is one half.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .arrays import row_kernel

LOWEST, HIGHEST = 1e-4, 0.4999  # corners beyond these are no filter


@lru_cache(maxsize=256)
def sections(f: float, poles: int, high_pass: bool) -> tuple[tuple[float, float, float, float, float], ...]:
    """(b0, b1, b2, a1, a2) of each section."""
    w = math.tan(math.pi * f)
    out = []
    if poles % 2:
        g = 1.0 / (1.0 + w)
        out.append((g, -g, 0.0, (w - 1.0) * g, 0.0) if high_pass else (w * g, w * g, 0.0, (w - 1.0) * g, 0.0))
    for k in range(poles // 2):
        angle = math.pi * (k + 1) / poles if poles % 2 else math.pi * (k + 0.5) / poles
        damp = 2.0 * math.cos(angle) * w
        g = 1.0 / (1.0 + damp + w * w)
        b = g if high_pass else w * w * g
        out.append((b, (-2.0 if high_pass else 2.0) * b, b, 2.0 * (w * w - 1.0) * g, (1.0 - damp + w * w) * g))
    return tuple(out)


def cascade(x: np.ndarray, secs: tuple) -> np.ndarray:
    """Rows of ``x`` through all sections, from rest."""
    y = np.ascontiguousarray(x.T)
    zero = np.zeros(y.shape[1])
    for b0, b1, b2, a1, a2 in secs:
        x1 = x2 = y1 = y2 = zero
        out = np.empty_like(y)
        for t in range(len(y)):
            v = b0 * y[t] + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, y[t], y1, v
            out[t] = v
        y = out
    return y.T


def filtered(x: np.ndarray, f_low: float, f_high: float, order: int, zero_phase: bool) -> np.ndarray:
    """Low cut at ``f_low`` first, then high cut at ``f_high``; a corner at the band's edge is left out."""
    poles = (order + 1) // 2 if zero_phase else order
    for f, high_pass, on in ((f_low, True, f_low > LOWEST), (f_high, False, f_high < HIGHEST)):
        if on:
            secs = sections(f, poles, high_pass)
            x = cascade(x, secs)
            if zero_phase:
                x = cascade(x[:, ::-1], secs)[:, ::-1]
    return x


def bandpass(f_min: float, f_max: float, dt: float, order: int = 14, zero_phase: bool = True, step: int = 1):
    """Column function of array<double>: band f_min to f_max in Hz, then every ``step``-th sample."""
    lo, hi = f_min * dt, f_max * dt
    if order < 1 or (lo < LOWEST and hi > HIGHEST):
        raise ValueError("the band has no corner within it, or the order is below 1")
    return row_kernel(lambda x: filtered(x, lo, hi, order, zero_phase)[:, :: max(1, step)])


def downsample(factor: int, dt: float, anti_alias: bool = True, order: int = 8, zero_phase: bool = True):
    """Column function: every ``factor``-th sample after a low-pass at 0.4 of the new rate."""
    corner = 1.0 / (2.5 * factor)

    def kernel(x: np.ndarray) -> np.ndarray:
        y = filtered(x, 0.0, corner, order, zero_phase) if anti_alias and factor > 1 else x
        return y[:, :: max(1, factor)]

    return row_kernel(kernel)
