"""Spectral whitening and cross-correlation of pairs of channels (numpy FFT in Arrow batches)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def smooth_bins(width_hz: float, nfft: int, fs: float) -> int:
    """A bandwidth in Hz as a number of bins, one at least, halves to even."""
    return max(1, round(width_hz * nfft / fs))


def whiten(spec: np.ndarray, bins: int = 1, eps: float = 1e-3, band: tuple[float, float] | None = None, df: float | None = None) -> np.ndarray:
    """Spectra (rows) with flat amplitude: over |spec| itself, or over its moving mean of ``bins`` bins.

    The divisor is at least eps times the row's mean amplitude. Outside ``band``
    a squared cosine falls to 0 at both ends of the spectrum.
    """
    mag = np.abs(spec)
    n = mag.shape[1]
    if bins == 1:
        divisor = mag
    else:
        lo = np.maximum(np.arange(n) - bins // 2, 0)
        hi = np.minimum(np.arange(n) - bins // 2 + bins, n)
        c = np.cumsum(np.pad(mag, ((0, 0), (1, 0))), axis=1)
        divisor = (c[:, hi] - c[:, lo]) / (hi - lo)
    out = spec / np.maximum(divisor, eps * np.maximum(mag.mean(axis=1, keepdims=True), 1e-30))
    if band is not None:
        if df is None:
            raise ValueError("a band needs df, the spacing of the bins")
        i1, i2 = min(n, math.floor(band[0] / df)), math.ceil(band[1] / df)
        if i1 > 0:
            out[:, :i1] *= np.cos(np.linspace(np.pi / 2, np.pi, i1)) ** 2
        if i2 < n:
            out[:, i2:] *= np.cos(np.linspace(np.pi, np.pi / 2, n - i2)) ** 2
    return out


def correlate(a: np.ndarray, b: np.ndarray, max_lag: int, whitening: bool | float = False, fs: float | None = None, band: tuple[float, float] | None = None, eps: float = 1e-3) -> np.ndarray:
    """cc[L] = sum over t of a[t] b[t + L] for L from -max_lag to max_lag, row by row."""
    n = a.shape[1]
    if max_lag > n - 1:
        raise ValueError("max_lag must be below the number of samples")
    nfft = 1 << math.ceil(math.log2(2 * n - 1)) if n > 1 else 1
    fa, fb = np.fft.rfft(a, nfft, axis=1), np.fft.rfft(b, nfft, axis=1)
    if whitening:
        if (whitening is not True or band is not None) and fs is None:
            raise ValueError("whitening by Hz needs fs")
        bins = 1 if whitening is True else smooth_bins(float(whitening), nfft, fs)
        df = None if fs is None else fs / nfft
        fa, fb = whiten(fa, bins, eps, band, df), whiten(fb, bins, eps, band, df)
    cc = np.fft.irfft(np.conj(fa) * fb, nfft, axis=1)
    return np.concatenate([cc[:, nfft - max_lag :] if max_lag else cc[:, :0], cc[:, : max_lag + 1]], axis=1)


def xcorr(a: Column, b: Column, max_lag: int, **options) -> Column:
    """Cross-correlation of two array columns as array<double> of 2 max_lag + 1 values; null if either is null or they differ in length."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        sizes = np.array([-1 if p is None or q is None or len(p) != len(q) else len(p) for p, q in zip(x, y, strict=True)])
        for n in np.unique(sizes[sizes > 0]):
            rows = np.nonzero(sizes == n)[0]
            step = max(1, 1_000_000 // int(n))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                got = correlate(np.stack([x.iloc[r] for r in part]).astype(np.float64), np.stack([y.iloc[r] for r in part]).astype(np.float64), max_lag, **options)
                for r, v in zip(part, got, strict=True):
                    out[r] = v
        return pd.Series(out, dtype=object)

    return run(a, b)
