"""Units: a grammar for written units, exponent vectors, conversion to canonical units.

    unit    := factor { ("·" | "*" | "." | blank)? factor | ("/" | "per") factor }
    factor  := number | symbol [ exponent ] | "(" unit ")" [ exponent ]
    number  := decimal [ ("e" | "x10^" | "^") digits ]
    exponent := "^"? digits, or superscripts

A unit is (scale, offset, exponents) over the dimensions metre, second, radian,
count and kelvin; strain is metre per metre, so it has no exponent at all. A
value is scale times the written one plus the offset, which only a temperature
by itself has. In a free text every phrase is parsed; of the phrases that are
units of the quantity sought the best stands for the text: one that is a clause
by itself, or whose clause speaks of what is recorded and not of other things or
of former times.

Defined results: null, blank and placeholder units ('-', 'n/a', 'unknown', ...)
count as not stated; a text that states no unit gives null; text of any length
is read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


class Unit(NamedTuple):
    scale: float
    offset: float
    dims: tuple[int, int, int, int, int]  # metre, second, radian, count, kelvin


# fixed values: prefixes, symbols and words of units
PREFIXES = {"pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "kilo": 1e3, "p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3}
BASES = {
    "strain": (1.0, (0, 0, 0, 0, 0)), "ε": (1.0, (0, 0, 0, 0, 0)),
    "m": (1.0, (1, 0, 0, 0, 0)), "metre": (1.0, (1, 0, 0, 0, 0)), "meter": (1.0, (1, 0, 0, 0, 0)),
    "s": (1.0, (0, 1, 0, 0, 0)), "sec": (1.0, (0, 1, 0, 0, 0)), "second": (1.0, (0, 1, 0, 0, 0)),
    "rad": (1.0, (0, 0, 1, 0, 0)), "radian": (1.0, (0, 0, 1, 0, 0)),
    "count": (1.0, (0, 0, 0, 1, 0)), "cts": (1.0, (0, 0, 0, 1, 0)), "ct": (1.0, (0, 0, 0, 1, 0)),
    "ft": (0.3048, (1, 0, 0, 0, 0)), "foot": (0.3048, (1, 0, 0, 0, 0)), "feet": (0.3048, (1, 0, 0, 0, 0)),
    "yd": (0.9144, (1, 0, 0, 0, 0)), "yard": (0.9144, (1, 0, 0, 0, 0)), "in": (0.0254, (1, 0, 0, 0, 0)), "inch": (0.0254, (1, 0, 0, 0, 0)),
}
TEMPERATURES = {"kelvin": (1.0, 0.0), "°c": (1.0, 273.15), "degc": (1.0, 273.15), "celsius": (1.0, 273.15), "°f": (5 / 9, 273.15 - 32 * 5 / 9), "degf": (5 / 9, 273.15 - 32 * 5 / 9), "fahrenheit": (5 / 9, 273.15 - 32 * 5 / 9)}
LENGTH, TEMPERATURE = (1, 0, 0, 0, 0), (0, 0, 0, 0, 1)
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")
PREFIXED = {"strain", "ε", "m", "metre", "meter", "s", "sec", "second", "rad", "radian"}
PLACEHOLDERS = {"", "-", "--", "n/a", "na", "none", "null", "nan", "unknown", "unk", "?", "unit", "units"}
LABELS = {"raw", "phase", "unit", "units", "amplitude", "gl", "gauge", "length"}

TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?(?:e[+-]?\d+|(?:x10)?\^[+-]?\d+)?)|(?P<word>[a-zA-Zµμε°]+(?:-(?=strain))?)|(?P<power>\^?[+-]?\d+)|(?P<op>[/*·^()\[\].]))", re.I)


def symbol(word: str) -> Unit | None:
    """One unit symbol or name, prefixed or not; case only matters nowhere here."""
    w = word.lower().rstrip("-")
    if w in TEMPERATURES or word == "K":
        return Unit(*TEMPERATURES.get(w, (1.0, 0.0)), TEMPERATURE)
    for s in (w, w[:-1] if len(w) > 3 and w.endswith("s") else w, w[:-2] if w.endswith("es") else w):
        if s in BASES:
            return Unit(BASES[s][0], 0.0, BASES[s][1])
    for p, k in PREFIXES.items():
        if w.startswith(p):
            rest = w[len(p) :].lstrip("-")
            for s in (rest, rest[:-1] if len(rest) > 3 and rest.endswith("s") else rest):
                if s in PREFIXED and (k > 1e-12 or s in ("strain", "ε")):  # pm is no length
                    return Unit(k * BASES[s][0], 0.0, BASES[s][1])
    return None


def _power(u: Unit, n: int) -> Unit:
    return Unit(u.scale**n, 0.0, tuple(d * n for d in u.dims))


def _times(a: Unit, b: Unit) -> Unit:
    return Unit(a.scale * b.scale, 0.0, tuple(x + y for x, y in zip(a.dims, b.dims, strict=True)))


def parse(text: str, at: int = 0, inside: bool = False) -> tuple[Unit | None, int]:
    """The longest unit that starts at ``at``, and where it ends; (None, at) if none does. Inside brackets a blank multiplies, too."""
    total, end, sign, named, prefix = Unit(1.0, 0.0, (0, 0, 0, 0, 0)), at, 1, False, None
    pos = at
    while m := TOKEN.match(text, pos):
        kind, t = m.lastgroup, m.group(m.lastgroup)
        if kind == "number":
            p = re.fullmatch(r"(\d+(?:\.\d+)?)(?:x10)?\^([+-]?\d+)", t, re.I)
            value = (10.0 if "x10" in t.lower() else float(p[1])) ** int(p[2]) * (float(p[1]) if "x10" in t.lower() else 1) if p else float(t)
            if named:
                break
            total = _times(total, Unit(value, 0.0, (0, 0, 0, 0, 0)))
            pos = m.end()
            continue
        if kind == "word":
            w = t.lower()
            if w == "per" and named:
                sign, pos = -1, m.end()
                continue
            if w.rstrip("-") in PREFIXES and len(w.rstrip("-")) > 2 and not symbol(t):
                prefix, pos = PREFIXES[w.rstrip("-")], m.end()
                continue
            u = symbol(t)
            if u is None or (named and sign == 1 and not inside and text[m.start() : m.start() + 1].isspace() and not _exponent(text, m.end())):
                break
            if prefix:
                u, prefix = Unit(u.scale * prefix, 0.0, u.dims), None
            pos = m.end()
            if e := _exponent(text, pos):
                u, pos = _power(u, e[0]), e[1]
            total, sign, named, end = _times(total, _power(u, sign)), 1, True, pos
            continue
        if kind == "op" and t == "(" and (not named or sign == -1 or text[: m.start()].rstrip().endswith(("*", "·"))):
            u, until = parse(text, m.end(), True)
            close = re.compile(r"\s*\)").match(text, until)
            if u is None or not close:
                break
            pos = close.end()
            if e := _exponent(text, pos):
                u, pos = _power(u, e[0]), e[1]
            total, sign, named, end = _times(total, _power(u, sign)), 1, True, pos
            continue
        if kind == "op" and t == "/" and named:
            sign, pos = -1, m.end()
            continue
        if kind == "op" and t in "*·" and named:
            pos = m.end()
            continue
        break
    if named and total.dims == TEMPERATURE and (m := re.match(r"\s*(\S+)$", text[at:end])) and (u := symbol(m[1])):
        return u, end  # a temperature by itself keeps its offset
    return (total, end) if named else (None, at)


def _exponent(text: str, at: int) -> tuple[int, int] | None:
    m = re.compile(r"\^?([+-]\d+)|\^(\d+)").match(text, at)
    return (int(m[1] or m[2]), m.end()) if m else None


def plain(text: str) -> str:
    """The text with superscripts as ^ and digits."""
    return re.sub(r"[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻]+", lambda m: "^" + m.group().translate(SUPERSCRIPTS), text)


def stated(text: str | None) -> bool:
    return text is not None and text.strip().lower() not in PLACEHOLDERS


@lru_cache(maxsize=65536)
def unit_of(text: str | None) -> Unit | None:
    """The unit a unit field holds, such as ``micro-strain s^-1``, ``phase [rad]``, ``count (int32)``."""
    if not stated(text):
        return None
    s = plain(text.strip())
    u, end = parse(s)
    if u and end == len(s):
        return u
    if m := re.search(r"\[([^\]]+)\]", s):
        u, end = parse(m[1].strip())
        if u and not m[1][end:].strip():
            return u
    s = re.sub(r"\([^)]*\)", " ", s).strip() or s
    u, end = parse(s, _after_labels(s, 0))
    return u if u and not s[end:].strip(" .") else None


def _after_labels(text: str, at: int) -> int:
    """Past words such as ``raw`` or ``phase`` in front of a unit."""
    while (m := re.compile(r"([A-Za-z]+)[\s:=]+").match(text, at)) and m[1].lower() in LABELS:
        at = m.end()
    return at


class Phrase(NamedTuple):
    """A unit within a text, the clause it stands in, and the clause's words beside it."""

    unit: Unit
    clause: int
    beside: tuple[str, ...]


START = re.compile(r"(?<![A-Za-z0-9µμε°.])(?=[A-Za-z0-9µμε°(])")
VALUE = re.compile(r"\d+(?:\.\d+)?\s*(?![\d.^x])(?=[A-Za-zµμε°(])")
WORD = re.compile(r"[A-Za-z]+")
PREPOSITION = re.compile(r"in\s+[A-Za-zµμε°(\d]", re.I)  # and no inches


def phrases(text: str) -> list[Phrase]:
    """Every phrase that is a unit, the longest from each beginning on; asides in brackets are clauses of their own.

    A number before a unit is its value, unless it is a power of ten.
    """
    found = []
    clauses = [c for part in re.split(r"[;,]", plain(text)) for c in (part, *re.findall(r"\(([^()]*)\)", part))]
    for at, clause in enumerate(clauses):
        pos = 0
        while m := START.search(clause, pos):
            begin = m.end()
            value = VALUE.match(clause, begin)
            if value and re.fullmatch(r"\d+(\.\d+)?e", clause[begin : value.end() + 1].strip(), re.I) and re.match(r"e[+-]?\d", clause[value.end() :], re.I):
                value = None
            u, end = parse(clause, value.end() if value else begin)
            preposition = PREPOSITION.match(clause, value.end() if value else begin) and not (value and u and u.dims == LENGTH and re.match(r"\s+of\b", clause[end:]))
            if u is None or preposition or re.match(r"[A-Za-z0-9µμε°]", clause[end:]):
                pos = (w.end() if (w := re.compile(r"[A-Za-z0-9µμε°.]+|.").match(clause, begin)) else begin + 1)
                continue
            beside = re.sub(r"\([^()]*\)", " ", clause[:begin]) + " " + re.sub(r"\([^()]*\)", " ", clause[end:])
            found.append(Phrase(u, at, tuple(w.lower() for w in WORD.findall(beside))))
            pos = end
    return found


# fixed values: words of a clause that speak of what is recorded, of other things and of former times, of what holds now
RECORDED = {"unit", "units", "stored", "recorded", "values", "samples", "sample", "payload", "amplitude", "amplitudes", "data", "gauge", "gl", "length"}
ELSEWHERE = {"plotted", "displayed", "shown", "spacing", "loop", "splice", "jacket", "slack", "was", "before", "formerly", "previously"}
NOW = {"now", "since"}


def best(found: list[Phrase]) -> Unit | None:
    """The unit of the phrase that its clause speaks most for, the first of those that tie; none if it speaks against all."""

    def score(p: Phrase) -> int:
        words = set(p.beside)
        return 2 * (not words) + bool(words & RECORDED) + bool(words & NOW) - 3 * len(words & ELSEWHERE)

    good = [p for p in found if score(p) >= 0]
    return max(good, key=lambda p: (score(p), -p.clause)).unit if good else None


@lru_cache(maxsize=65536)
def signal_unit_in(text: str | None) -> Unit | None:
    """The unit that a free text states for the recorded values (strain, phase or counts, or their rates)."""
    return best([p for p in phrases(text) if is_signal(p.unit)]) if text else None


def is_signal(u: Unit) -> bool:
    m, s, rad, count, kelvin = u.dims
    return m == 0 and kelvin == 0 and s in (0, -1) and (rad, count) in ((0, 0), (1, 0), (0, 1))


@lru_cache(maxsize=65536)
def length_unit_in(note: str | None) -> Unit | None:
    """The unit of length that a note states for the gauge."""
    return best([p for p in phrases(note) if p.unit.dims == LENGTH]) if stated(note) else None


NAMES = {1.0: "", 1e-6: "micro", 1e-9: "nano", 1e-12: "pico", 1e-3: "milli"}


def name_of(u: Unit) -> str | None:
    """The plain name of a unit, as in ``nanostrain/s``; null for a unit that has none here."""
    _, s, rad, count, _ = u.dims
    if u.dims == TEMPERATURE:
        return next((n for n in ("K", "°C", "°F") if (t := symbol(n)) and abs(t.scale - u.scale) < 1e-9 and abs(t.offset - u.offset) < 1e-9), None)
    if u.dims == LENGTH:
        for name, k in (("m", 1.0), ("mm", 1e-3), ("cm", 1e-2), ("ft", 0.3048), ("in", 0.0254), ("yd", 0.9144)):
            if abs(u.scale / k - 1) < 1e-9:
                return name
        return None
    if not is_signal(u):
        return None
    kind = "radian" if rad else "count" if count else "strain"
    for k, prefix in NAMES.items():
        if abs(u.scale / k - 1) < 1e-6:
            return prefix + kind + "/s" * (s == -1)
    return None


@lru_cache(maxsize=65536)
def quantity_of(text: str | None) -> tuple[float, Unit] | None:
    """A number with its unit, such as ``12.5 ft``, ``-3e-9 strain/s`` or ``21 °C``: the value in base units, and the unit."""
    m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?(?:e[+-]?\d+)?)\s*(\D.*)", text or "", re.I | re.S)
    u = unit_of(m[2]) if m else None
    return (float(m[1]) * u.scale + u.offset, u) if u else None
