"""Column profiles of two versions of a table, matched into renames.

A profile is the column's name, the type of all its filled values, and a sketch
of these values: the value itself where a version has one, else minima of hashes
of its (row, value) cells and a digest of which rows share a value. Columns of
the same name are the same column; the others are paired by an assignment of the
greatest total likeness. Likeness joins the sketches, the letters of the names,
and what the corpus says of two names: whether they ever stand in one version
(then they are two quantities), and how often one took over from the other with
like values.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .stamps import readings

VALUE, NAME, RECURRENCE = 0.35, 0.2, 0.45  # shares of the likeness
SURE = 0.4  # pairs below it stay apart
PRIOR, APART = 0.3, 0.3  # share of handovers with like values, of names never seen to hand over; more of it for names that could have stood together
TOGETHER = 0.05  # share of versions with both names from which two names are two quantities
RECODED, INSTANT, NEAR = 0.9, 0.6, 0.5  # likeness of values that are equal but for a code, of instants, of close numbers


class Profile(NamedTuple):
    """A column: type None where nothing is filled."""

    name: str
    type: str | None
    filled: int = 0
    distinct: int = 0
    minima: tuple[int, ...] = ()
    classes: int | None = None
    value: str | None = None


@lru_cache(maxsize=65536)
def name_likeness(a: str, b: str) -> float:
    """Likeness of the names' letters: of the whole, of a beginning, or of an abbreviation that keeps the first letter."""
    x, y = (re.sub(r"[^a-z0-9]", "", n.lower()) for n in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    short, long = sorted((x, y), key=len)
    letters = SequenceMatcher(None, x, y).ratio()
    if len(short) > 2 and long.startswith(short):
        return max(letters, 0.85)
    at = iter(long)
    return max(letters, 0.6 if len(short) > 1 and short[0] == long[0] and all(c in at for c in short) else 0.0)


@lru_cache(maxsize=65536)
def instant(value: str) -> int | None:
    """The first instant a value can be read as, in microseconds."""
    found = readings(value, None)
    return found[0][1] if found else None


def instant_rank(columns: list[Profile]) -> dict[str, int]:
    """Place of each column among its version's instants, the earliest first."""
    at = sorted((t, c.name) for c in columns if c.value is not None and (t := instant(c.value)) is not None)
    return {name: i for i, (_, name) in enumerate(at)}


def _single(a: str, b: str, same_place: bool) -> tuple[float, float]:
    """(likeness, how much it tells) of two single values."""
    if a == b:
        return 1.0, min(1.0, 0.4 + 0.2 * len(re.sub(r"[.0+\-]", "", a)))
    ta, tb = instant(a), instant(b)
    if ta is not None and tb is not None:
        return (INSTANT if same_place else INSTANT / 2), 1.0
    try:
        x, y = float(a), float(b)
    except ValueError:
        return 0.0, 1.0
    return NEAR * max(0.0, 1 - 20 * abs(x - y) / max(abs(x), abs(y))), 1.0


def value_likeness(a: Profile, b: Profile, same_place: bool = True) -> tuple[float | None, float]:
    """(likeness of the values, how much it tells); None where one side has none."""
    if not a.filled or not b.filled:
        return None, 1.0
    if a.value is not None and b.value is not None:
        return _single(a.value, b.value, same_place)
    tells = (0.4, 0.7, 1.0)[min(a.distinct, b.distinct, 3) - 1]
    share = sum(x == y for x, y in zip(a.minima, b.minima, strict=True)) / max(len(a.minima), 1)
    if share < RECODED and a.classes == b.classes and 2 <= a.distinct == b.distinct <= min(a.filled, b.filled) // 2:
        return RECODED, tells  # the same rows share a value, whatever it is called
    return share, tells


class Candidate(NamedTuple):
    """A column that went and one that came."""

    old: str
    new: str
    value: float | None
    tells: float
    exact: bool


def candidates(old: list[Profile], new: list[Profile]) -> list[Candidate]:
    """All pairs of a column that went and one that came."""
    was, now = {c.name for c in old}, {c.name for c in new}
    gone, come = [c for c in old if c.name not in now], [c for c in new if c.name not in was]
    if not gone or not come:
        return []
    place, place2 = instant_rank(old), instant_rank(new)
    out = []
    for a in gone:
        for b in come:
            v, tells = value_likeness(a, b, place.get(a.name) == place2.get(b.name))
            out.append(Candidate(a.name, b.name, v, tells, v == 1.0 and min(a.distinct, b.distinct) >= 5))
    return out


def likeness(c: Candidate, together: float, expected: float, handed: float, compared: float) -> float:
    """Likeness of a candidate from 0 to 1.

    ``together`` is the share of versions with both names among those with the
    rarer one, ``expected`` the number of such versions if names fell
    independently; ``compared`` handovers elsewhere between the two names had
    values to compare, ``handed`` of them like ones.
    """
    prior = PRIOR + (APART * expected / (expected + 5) if together == 0 else 0.0)
    recurrence = (handed + prior) / (compared + 1)
    value = recurrence if c.value is None else c.value * c.tells
    apart = max(0.0, 1 - together / TOGETHER)
    if c.exact:
        apart = max(apart, 0.8)  # many different values, row by row the same
    return apart * (VALUE * value + NAME * name_likeness(c.old, c.new) + RECURRENCE * recurrence)


def renames(scored: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """(old, new) of the assignment of greatest total likeness, over candidates of at least ``SURE``."""
    sure = [s for s in scored if s[2] >= SURE]
    gone, come = sorted({s[0] for s in sure}), sorted({s[1] for s in sure})
    if not sure:
        return []
    gain = np.zeros((len(gone), len(come)))
    for a, b, s in sure:
        gain[gone.index(a), come.index(b)] = s
    return [(gone[i], come[j]) for i, j in assignment(gain) if gain[i, j] > 0]


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the greatest total gain (Kuhn-Munkres with potentials)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.nonzero(~used[1:])[0] + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < low[free]
            low[free[better]], came[free[better]] = slack[better], j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[came[j0]]
            j0 = came[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(c, r) if flip else (r, c) for r, c in pairs]


def changes(old: list[Profile], new: list[Profile], paired: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(kind, old name, new name) of every difference between two versions' profiles, given their renames."""
    was, now = {c.name: c for c in old}, {c.name: c for c in new}
    went, came = dict(paired), {n for _, n in paired}
    out = [("renamed", o, n) for o, n in paired]
    out += [("removed", n, "") for n in was if n not in now and n not in went] + [("added", "", n) for n in now if n not in was and n not in came]
    same = [(c, now[went.get(n, n)]) for n, c in was.items() if went.get(n, n) in now]
    return out + [("retyped", a.name, b.name) for a, b in same if a.type and b.type and a.type != b.type]
