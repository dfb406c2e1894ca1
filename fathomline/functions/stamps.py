"""Every valid reading of a written time stamp.

A reading is (form, microseconds since the epoch in UTC, cost). Numeric dates
begin with the year, or with the day if dotted; those with slashes and the year
last have a reading with the day and one with the month first. Bare numbers
count from the epoch in seconds, milli-, micro- or nanoseconds, whichever falls
into 1990 to 2100. A stamp without a zone is local time of the source's own
zone, and a local time that occurs twice has two readings. A zone's abbreviation
has a reading for each offset it may mean; those that the source's own zone
doesn't share cost more. Fractions are cut at the microsecond.

Defined results: null, empty and unreadable stamps have no reading; a local time
that a clock change skips is read with the offset before the change; an unknown
zone name of the source counts as UTC.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from zoneinfo import ZoneInfo

# fixed values: month names, and zone abbreviations with the offsets in minutes they may mean
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
ABBREVIATIONS = {
    "UTC": (0,), "GMT": (0,), "Z": (0,), "UT": (0,), "WET": (0,), "WEST": (60,), "BST": (60, 360), "CET": (60,), "MET": (60,), "CEST": (120,), "MEST": (120,), "EET": (120,), "EEST": (180,), "MSK": (180,),
    "AST": (-240, 180), "ADT": (-180,), "EST": (-300, 600), "EDT": (-240, 660), "CST": (-360, 480, -300), "CDT": (-300, -240), "MST": (-420, 390), "MDT": (-360,), "PST": (-480, 480), "PDT": (-420,), "AKST": (-540,), "AKDT": (-480,), "HST": (-600,),
    "NST": (-210,), "NDT": (-150,), "JST": (540,), "KST": (540,), "IST": (330, 60, 120), "NPT": (345,), "ACST": (570,), "ACDT": (630,), "AEST": (600,), "AEDT": (660,), "AWST": (480,), "NZST": (720,), "NZDT": (780,),
    "AZOT": (-60,), "AZOST": (0,), "GST": (240, -120), "SST": (-660, 480), "WST": (480, 780), "ECT": (-300, -240), "AMT": (-240, 240),
}
FOREIGN = 20.0  # cost of a meaning that the source's own zone hasn't, where another one is its own
EARLIEST, LATEST = 631_152_000, 4_102_444_800  # 1990 and 2100, in seconds
EPOCH = datetime(1970, 1, 1)
MICRO = timedelta(microseconds=1)
MINUTE = 60_000_000

CLOCK = r"(?P<H>\d{1,2}):?(?P<M>\d{2})(?::?(?P<S>\d{2})(?:[.,](?P<F>\d+))?)?"
ZONE = r"\s*(?P<z>Z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?)?\s*(?:\[(?P<zone>[A-Za-z0-9_+\-/]+)\])?"
FORMS = [
    ("ymd", re.compile(rf"(?P<Y>\d{{4}})(?P<sep>[-/])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?P<t>[T ]){CLOCK}{ZONE}")),
    ("ordinal", re.compile(rf"(?P<Y>\d{{4}})-(?P<j>\d{{3}})[T ]{CLOCK}{ZONE}")),
    ("compact", re.compile(rf"(?P<Y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[T ]{CLOCK}{ZONE}")),
    ("slashed", re.compile(rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<Y>\d{{4}})[T ]{CLOCK}{ZONE}")),
    ("dotted", re.compile(rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<Y>\d{{4}})[T ]{CLOCK}{ZONE}")),
    ("name_first", re.compile(rf"(?P<b>[A-Za-z]{{3,9}})\.? (?P<d>\d{{1,2}}),? (?P<Y>\d{{4}}),? {CLOCK}\s*(?P<p>[AaPp]\.?[Mm]\.?)?{ZONE}")),
    ("day_first", re.compile(rf"(?:[A-Za-z]{{3}}, )?(?P<d>\d{{1,2}})[ -](?P<b>[A-Za-z]{{3,9}})\.?[ -](?P<Y>\d{{4}}),? {CLOCK}\s*(?P<p>[AaPp]\.?[Mm]\.?)?{ZONE}")),
]
NUMBER = re.compile(r"[+]?\d+(?:\.\d+)?(?:[eE][+]?\d+)?")
CANONICAL = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00")


@lru_cache(maxsize=512)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:  # noqa: BLE001 - a zone nobody knows
        return None


def _local(at: datetime, zone: ZoneInfo) -> list[tuple[int, str, int]]:
    """(fold, abbreviation, offset in minutes) of a local time; one entry unless it occurs twice."""
    out = []
    for fold in (0, 1):
        t = at.replace(tzinfo=zone, fold=fold)
        back = t.astimezone(UTC).astimezone(zone)
        if back.replace(tzinfo=None) == at and (not out or t.utcoffset() != timedelta(minutes=out[0][2])):
            out.append((fold, t.tzname() or "", int(t.utcoffset().total_seconds() // 60)))
    return out or [(0, "", int(at.replace(tzinfo=zone, fold=0).utcoffset().total_seconds() // 60))]


def _epoch(text: str) -> list[tuple[str, int, float]]:
    try:
        v = Decimal(text)
    except InvalidOperation:
        return []
    return [(f"epoch_{u}", int(v * 1_000_000 / k), 0.0) for u, k in (("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)) if EARLIEST <= v / k < LATEST]


def readings(text: str | None, tz: str | None) -> list[tuple[str, int, float]]:
    """All valid (form, utc microseconds, cost) of a stamp, each instant once, the first the likeliest."""
    if text is None:
        return []
    s = text.strip()
    if not s:
        return []
    if NUMBER.fullmatch(s):
        return _epoch(s)
    found: dict[int, tuple[str, int, float]] = {}
    for form, pattern in FORMS:
        if m := pattern.fullmatch(s):
            g = m.groupdict()
            for tag, parts in ((form, g), (form + "_us", g | {"d": g["m"], "m": g["d"]})) if form == "slashed" else ((form, g),):
                for r in _dated(tag, parts, tz):
                    found.setdefault(r[1], r)
    return list(found.values())


def _dated(form: str, g: dict, tz: str | None) -> list[tuple[str, int, float]]:
    hour = int(g["H"])
    if half := g.get("p"):
        if not 1 <= hour <= 12:
            return []
        hour = hour % 12 + 12 * (half[0] in "pP")
    try:
        if g.get("j"):
            day = datetime(int(g["Y"]), 1, 1) + timedelta(days=int(g["j"]) - 1)
            if day.year != int(g["Y"]) or g["j"] == "000":
                return []
            month, dom = day.month, day.day
        else:
            month = MONTHS.get(g["b"][:3].lower(), 0) if g.get("b") else int(g["m"])
            dom = int(g["d"])
        whole, leap = (int(g["S"] or 0), 0)
        if whole == 60:
            whole, leap = 59, 1
        at = datetime(int(g["Y"]), month, dom, hour, int(g["M"]), whole) + timedelta(seconds=leap)
    except ValueError:
        return []
    micros = (at - EPOCH) // MICRO + int(((g.get("F") or "") + "000000")[:6])
    tag = form + (g.get("sep") or "") + ("." if g.get("F") else "")
    z, zone = g.get("z"), g.get("zone")
    if z and re.search(r"\d", z):
        digits = re.sub(r"\D", "", z)
        minutes = (int(digits[:2]) * 60 + int(digits[2:] or 0)) * (-1 if "-" in z else 1)
        return [(tag + "+", micros - minutes * MINUTE, 0.0)]
    own = _zone(tz)
    if z:
        name = z.upper()
        mine = [o for _, n, o in _local(at, own) if n == name] if own and name not in ("UTC", "GMT", "Z") else []
        theirs = [o for o in ABBREVIATIONS.get(name, ()) if o not in mine]
        return [(tag + "abbr", micros - o * MINUTE, 0.0) for o in mine] + [(f"{tag}abbr{o}", micros - o * MINUTE, FOREIGN if mine else 0.0) for o in theirs]
    own = _zone(zone) if zone else own or ZoneInfo("UTC")
    if own is None:
        return []
    return [(tag + "local", micros - o * MINUTE, 0.0) for _, _, o in _local(at, own)]
