"""Scalar expressions of the field: units, factors to strain, times in names, stamps as text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit names, the longest first, as the first one found in a text counts
UNIT_NAMES = ["microstrain/s", "microstrain", "strain/s", "strain", "radian/s", "radian", "count"]
# fixed values: photo-elastic constant, the drawing number and last version whose sign is flipped
PHOTO_ELASTIC, FLIPPED_DRAWING, FLIPPED_VERSION = 0.78, 7804701, 2.0
RATES = {"count": "count", "radian": "radian/s", "strain": "strain/s", "microstrain": "microstrain/s"}


def normalize_unit(text: Column) -> Column:
    """The first known unit in a text, ``/sec`` read as ``/s``; 'unknown' if there is none."""
    t = F.replace(F.lower(text), F.lit("/sec"), F.lit("/s"))
    out = F.lit("unknown")
    for u in reversed(UNIT_NAMES):
        out = F.when(F.contains(t, F.lit(u)), u).otherwise(out)
    return out


def unit_of_rate(unit: Column) -> Column:
    """Unit of the time derivative; a unit that is a rate already, or has none, stays."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv]), unit), unit)


def unit_of_integral(unit: Column) -> Column:
    return F.regexp_replace(unit, "/s$", "")


def physical_unit(unit: Column) -> Column:
    """Unit after the factor to strain: counts and radians become strain, rates stay rates."""
    return F.when(unit.isin("count", "radian"), "strain").when(unit == "radian/s", "strain/s").otherwise(unit)


def to_physical(samples: Column, unit: Column, factor: Column) -> Column:
    """Samples times the factor; raw units with a factor of 1 are an error."""
    raw = unit.isin("count", "radian", "radian/s") & (F.coalesce(factor, F.lit(1.0)) == 1.0)
    return F.when(raw, F.raise_error(F.lit("no factor to strain for raw units"))).otherwise(F.transform(samples, lambda x: x.cast("double") * factor))


def count_to_strain(wavelength_m: Column, index: Column, gauge_m: Column, drawing: Column, version: Column) -> Column:
    """Strain per count of an interrogator that counts 2**15 per half turn; 1 if an attribute is missing."""
    sign = F.when((drawing == FLIPPED_DRAWING) & (version.try_cast("double") <= FLIPPED_VERSION), -1.0).otherwise(1.0)
    value = sign * (math.pi / 2**15) * wavelength_m / (4 * math.pi * PHOTO_ELASTIC * index * gauge_m)
    return F.coalesce(value, F.lit(1.0))


def radian_to_strain(nanostrain_per_radian: Column) -> Column:
    return F.coalesce(1e-9 * nanostrain_per_radian, F.lit(1.0))


def strain_factor(origin: Column, count_factor: Column, radian_factor: Column) -> Column:
    """Factor to strain by the recording system."""
    return F.when(origin == "OptaSense", count_factor).when(origin == "APSensing", radian_factor).otherwise(F.lit(1.0))


def data_kind(groups: Column, has_event_id: Column) -> Column:
    """Kind of a file from the names at its root; the order of the rules decides."""
    has = lambda name: F.array_contains(groups, name)
    return F.when(has("Data"), "Proc").when(has("acqSpec"), "ASN").when(has("Acquisition"), "OptaSense").when(has("ProcessingServer"), "APSensing").when(has("data") & has_event_id, "Event").otherwise("Unknown")


def data_origin(kind: Column, meta: Column) -> Column:
    """Recording system: the kind itself, but for processed files by the attributes they kept."""
    has = lambda k: F.coalesce(F.map_contains_key(meta, k), F.lit(False))
    kept = F.when(has("AcquisitionId"), "OptaSense").when(has("acqSpec.YvsXDelay"), "ASN").when(has("ProcessingServer.ClassifierVersion"), "APSensing").when(has("acquisition.num_channels"), "Sintela").otherwise("Unknown")
    return F.when(kind == "Proc", kept).otherwise(kind)


def is_segy(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".segy"))


def dated_path_time(path: Column) -> Column:
    """Microseconds of ``.../YYYYMMDD/.../HHMMSS.ext`` in UTC; null for other names and impossible dates."""
    day = F.regexp_extract(path, r"(?:^|/)(\d{8})/(?:.*/)?\d{6}\.[^/.]+$", 1)
    clock = F.regexp_extract(path, r"/(\d{6})\.[^/.]+$", 1)
    part = lambda s, a, n: F.substring(s, a, n).try_cast("int")
    days = F.unix_date(F.try_to_date(F.when(day != "", day), "yyyyMMdd")).cast("bigint")
    h, m, s = part(clock, 1, 2), part(clock, 3, 2), part(clock, 5, 2)
    return F.when((h < 24) & (m < 60) & (s < 60), (days * 86_400 + h * 3600 + m * 60 + s) * 1_000_000)



def iso_timestamp(us: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffff+00:00, always with microseconds, whatever the session's zone."""
    day, rest = F.floor(us / F.lit(86_400_000_000)).cast("bigint"), F.pmod(us, F.lit(86_400_000_000))
    clock = F.format_string("%02d:%02d:%02d.%06d", F.floor(rest / F.lit(3_600_000_000)), F.floor(rest / F.lit(60_000_000)) % 60, F.floor(rest / F.lit(1_000_000)) % 60, rest % 1_000_000)
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), clock, F.lit("+00:00"))


def parse_iso(text: Column) -> Column:
    """Microseconds of an ISO stamp; one without a zone is UTC."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def processed_name(system: Column, us: Column, dated: bool = False) -> Column:
    """Name of a processed file: Proc<system>-YYYY-MM-DDTHHMMSSZ.h5, in a folder of its day if ``dated``."""
    iso = iso_timestamp(us)
    stem = F.when(F.startswith(system, F.lit("Proc")), system).otherwise(F.concat(F.lit("Proc"), system))
    name = F.concat(stem, F.lit("-"), F.substring(iso, 1, 11), F.replace(F.substring(iso, 12, 8), F.lit(":"), F.lit("")), F.lit("Z.h5"))
    return F.concat(F.replace(F.substring(iso, 1, 10), F.lit("-"), F.lit("")), F.lit("/"), name) if dated else name


def ibm_float(word: Column) -> Column:
    """Value of a 32-bit word of the hexadecimal float format: sign, exponent of 16 (less 64), 24-bit fraction."""
    w = word.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    sign = 1 - 2 * F.shiftright(w, 31)
    power = F.shiftright(w, 24).bitwiseAND(F.lit(0x7F)) - 64
    return sign * (w.bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(1 << 24))) * F.pow(F.lit(16.0), power)
