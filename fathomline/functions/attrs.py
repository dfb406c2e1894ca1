"""Attributes kept as JSON objects: values as written, and their types."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


class Int(str):
    """An integer as it was written."""


class Frac(str):
    """A fractional number as it was written."""


_DECODER = json.JSONDecoder(parse_int=Int, parse_float=Frac)


def read_attrs(text: str | None) -> dict:
    """The attributes of a JSON object; numbers keep their text. What is no object has none."""
    if text is None:
        return {}
    try:
        v = _DECODER.decode(text)
    except ValueError:
        return {}
    return v if isinstance(v, dict) else {}


def first_text(value) -> str | None:
    """A scalar as text; a list of one element counts as the element."""
    while isinstance(value, list) and len(value) == 1:
        value = value[0]
    return None if value is None or isinstance(value, list | dict | bool) else str(value)


def attr_text(attrs: Column, pattern: str) -> Column:
    """Text of the first non-empty attribute whose name, in lower case without ``_``, ``-`` and blanks, matches ``pattern``; else of the first."""
    rule = re.compile(pattern)

    @F.pandas_udf(StringType())
    def read(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = [first_text(v) for k, v in read_attrs(t).items() if rule.fullmatch(re.sub(r"[\s_\-]", "", k.lower()))]
            out.append(next((v for v in found if v), found[0] if found else None))
        return pd.Series(out, dtype=object)

    return read(attrs)


def attr_texts(attrs: Column) -> Column:
    """All attributes as a map of name to text, numbers as they were written, lists of one element as the element; null stays null."""

    def text(value) -> str | None:
        while isinstance(value, list) and len(value) == 1:
            value = value[0]
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value)

    @F.pandas_udf(MapType(StringType(), StringType()))
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else {k: text(v) for k, v in read_attrs(t).items()} for t in texts], dtype=object)

    return read(attrs)
