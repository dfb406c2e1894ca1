"""Robust control charts over many series at once (rows of a matrix).

Each row is one series. Its scatter is 1.4826 times the median absolute
deviation of its sample-to-sample differences. A chart walks along the series
with an exponentially weighted mean and scale; a value beyond the control limit
is suspected and enters the updates only clipped to that limit. More than three
suspected values on end are a new level, and the mean moves there. A spike is
suspected by the chart that runs forward and by the one that runs backward.
"""

from __future__ import annotations

import numpy as np

PHYSICAL_LIMIT = 1e12
STUCK_RUN = 10
JUMP = 10.0
LONGEST = 3
LIMIT = 6.0
PIECE, RUN_UP = 8192, 512
WEIGHT_MEAN, WEIGHT_SCALE = 0.6, 0.08


def run_lengths(x: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each element lies in (NaN equals nothing)."""
    k, n = x.shape
    new = np.ones((k, n), bool)
    new[:, 1:] = ~(x[:, 1:] == x[:, :-1])
    run = np.cumsum(new.ravel()) - 1
    return np.bincount(run)[run].reshape(k, n)


def _median_rows(a: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN for rows without values."""
    s = np.sort(a, axis=1)
    n = (~np.isnan(s)).sum(axis=1)
    at = np.arange(len(s))
    top = np.maximum(n - 1, 0)
    lo, hi = s[at, top // 2], s[at, np.minimum((top + 1) // 2, s.shape[1] - 1)]
    return np.where(n > 0, (lo + hi) / 2, np.nan)


def scatter(x: np.ndarray) -> np.ndarray:
    """Usual sample-to-sample scatter of each row, over neighbours that are both there."""
    if x.shape[1] < 2:
        return np.full(len(x), np.nan)
    d = np.diff(x, axis=1)
    return 1.4826 * _median_rows(np.abs(d - _median_rows(d)[:, None]))


State = tuple[np.ndarray, np.ndarray, np.ndarray]  # mean, variance, suspected values on end


def _begin(x: np.ndarray, s0: np.ndarray) -> State:
    """The state before the first value: the level is the value nearest to the median of the first ones."""
    k, n = x.shape
    head = x[:, : min(n, 9)]
    mean = _median_rows(head)
    mean = np.where(np.isnan(mean), _median_rows(x), mean)
    # the median may lie on neither side of an early step
    near = np.nanargmin(np.where(np.isnan(head), np.inf, np.abs(head - mean[:, None])), axis=1)
    at = head[np.arange(k), near]
    return np.where(np.isnan(at), mean, at), s0**2, np.zeros(k, np.int64)


def _walk(x: np.ndarray, s0: np.ndarray, state: State) -> tuple[np.ndarray, State]:
    """Suspected values of each row from a state on, and the state after the last value; NaNs are passed over."""
    k, n = x.shape
    (mean, var, on), floor = state, s0**2
    out = np.zeros((k, n), bool)
    for t in range(n):
        v = x[:, t]
        there = ~np.isnan(v)
        limit = LIMIT * np.sqrt(var)
        r = np.where(there, v - mean, 0.0)
        bad = np.abs(r) > limit
        out[:, t] = bad
        on = np.where(bad, on + 1, np.where(there, 0, on))
        moved = on > LONGEST
        clipped = np.clip(r, -limit, limit)
        mean = np.where(moved, v, mean + WEIGHT_MEAN * np.where(bad, 0.15, 1.0) * clipped)
        mean = np.where(np.isnan(mean), 0.0, mean)
        on = np.where(moved, 0, on)
        w = WEIGHT_SCALE * np.where(bad, 0.25, 1.0)
        var = np.where(there, np.maximum(floor, (1 - w) * var + w * clipped**2), var)
    return out, (mean, var, on)


def chart(x: np.ndarray, s0: np.ndarray) -> np.ndarray:
    """Suspected values of each row.

    Long rows are walked in pieces at once. A piece begins with the state that a
    run-up over the values before it gives; where that isn't exactly the state
    the piece before ends with, the piece is walked again from there. So the
    chart is that of the whole row, whatever its length.
    """
    k, n = x.shape
    if n <= PIECE:
        return _walk(x, s0, _begin(x, s0))[0]
    pieces = -(-n // PIECE)
    cut = np.full((k, pieces * PIECE), np.nan)
    cut[:, :n] = x
    cut = cut.reshape(k, pieces, PIECE)
    rows = lambda a: a.reshape(k * pieces, *a.shape[2:])
    runup = cut[:, :-1, -RUN_UP:].reshape(k * (pieces - 1), RUN_UP)
    late = np.repeat(s0, pieces - 1)
    begun = [np.concatenate([a[:, None], b.reshape(k, -1)], axis=1) for a, b in zip(_begin(x, s0), _walk(runup, late, _begin(runup, late))[1], strict=True)]
    out, ended = _walk(rows(cut), np.repeat(s0, pieces), tuple(b.ravel() for b in begun))
    out, ended = out.reshape(k, pieces, PIECE), [e.reshape(k, pieces) for e in ended]
    for p in range(1, pieces):
        again = np.nonzero(np.any([b[:, p] != e[:, p - 1] for b, e in zip(begun, ended, strict=True)], axis=0))[0]
        if len(again):
            out[again, p], end = _walk(cut[again, p], s0[again], tuple(e[again, p - 1] for e in ended))
            for e, v in zip(ended, end, strict=True):
                e[again, p] = v
    return out.reshape(k, -1)[:, :n]


def _beside(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the nearest ok value before and after it (NaN where none is)."""
    k, n = x.shape
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(ok, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(ok, at, n)[:, ::-1], axis=1)[:, ::-1]
    rows = np.arange(k)[:, None]
    return np.where(before >= 0, x[rows, np.maximum(before, 0)], np.nan), np.where(after < n, x[rows, np.minimum(after, n - 1)], np.nan)


def implausible(x: np.ndarray) -> np.ndarray:
    """Mask of implausible values in each row: impossible, stuck or spike."""
    if not x.size:
        return np.zeros(x.shape, bool)
    with np.errstate(all="ignore"):
        impossible = ~np.isfinite(x) | (np.abs(x) >= PHYSICAL_LIMIT)
        stuck = (run_lengths(x) >= STUCK_RUN) & ~impossible
        y = np.where(impossible, np.nan, x)
        flags = impossible | stuck
        # a stuck run keeps one value in the chart: the level goes on from there
        z = np.where(stuck, np.nan, y)
        s = scatter(z)
        usable = np.isfinite(s) & (s > 0)
        if usable.any():
            flags[usable] |= _spikes(z[usable], s[usable])
        return flags


def _spikes(z: np.ndarray, s: np.ndarray) -> np.ndarray:
    k, n = z.shape
    there = ~np.isnan(z)
    suspected = chart(z, s) | chart(z[:, ::-1], s)[:, ::-1]
    # samples on end, over missing ones
    order = np.argsort(~there, axis=1, kind="stable")
    rows = np.arange(k)[:, None]
    c, sus, ok = z[rows, order], suspected[rows, order], there[rows, order]
    a, b = _beside(c, ok & ~sus)
    jump = JUMP * s[:, None]
    up_a, up_b = c - a, c - b
    far_a, far_b = np.abs(up_a) > jump, np.abs(up_b) > jump
    edge = (np.isnan(a) & far_b) | (np.isnan(b) & far_a)
    away = sus & ok & ((far_a & far_b & (np.sign(up_a) == np.sign(up_b))) | edge)
    lengths = _true_runs(sus & ok)
    local = _local_scatter(c, sus | ~ok)
    calm = np.fmin(np.abs(up_a), np.abs(up_b)) > 4.0 * np.where(np.isnan(local), 0.0, local)
    found = away & (lengths <= LONGEST) & calm
    out = np.zeros((k, n), bool)
    out[rows, order] = found
    return out


def _true_runs(m: np.ndarray) -> np.ndarray:
    """Length of the run of set flags that each element lies in, 0 where it isn't set."""
    k, n = m.shape
    new = np.ones((k, n), bool)
    new[:, 1:] = m[:, 1:] != m[:, :-1]
    run = np.cumsum(new.ravel()) - 1
    return np.where(m, np.bincount(run)[run].reshape(k, n), 0)


def _local_scatter(x: np.ndarray, skip: np.ndarray, reach: int = 6) -> np.ndarray:
    """Median absolute difference among the values around each element, without skipped ones."""
    y = np.where(skip, np.nan, x)
    d = np.abs(np.diff(y, axis=1))
    k, n = x.shape
    pad = np.full((k, reach), np.nan)
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, d, pad, np.full((k, 1), np.nan)], axis=1), 2 * reach, axis=1)
    out = np.full((k, n), np.nan)
    rows, cols = np.nonzero(skip)  # only wanted at suspected values
    if len(rows):
        out[rows, cols] = 1.4826 * _median_rows(w[rows, cols])
    return out
