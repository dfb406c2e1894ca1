"""File paths: one spelling for every way of writing the same path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """The path without outer blanks, scheme, percent codes, backslashes, doubled
    slashes, ``.`` and ``..`` steps; the extension in lower case. Null stays null."""
    p = F.regexp_replace(path, r"^\s+|\s+$", "")
    p = F.regexp_replace(p, r"^(?i:file:)(?=[/\\])(//(?=[/\\]))?", "")
    p = F.translate(p, "\\", "/")
    p = F.when(F.contains(p, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)).otherwise(p)
    rooted = F.startswith(p, F.lit("/"))
    steps = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == "..") & rooted, acc).otherwise(F.concat(acc, F.array(x))),
    )
    walked = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(steps, "/"))
    p = F.when(p.rlike(r"//|(^|/)\.{1,2}(/|$)"), walked).otherwise(p)
    ext = F.regexp_extract(p, r"\.[A-Za-z0-9]*[A-Z][A-Za-z0-9]*$", 0)
    return F.when(ext != "", F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(ext)), F.lower(ext))).otherwise(p)
