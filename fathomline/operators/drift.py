"""Schemas that drift between the files of a source: profiles, changes, one table.

Each version (file) of a source is compared with the one before it. A version's
columns are profiled: type of all filled values, and a sketch of the values (see
``functions.columns``). Versions are walked in their order inside chunks of each
source, so that a source with a third of all versions is many tasks; a chunk's
first version meets the last one before it by an edge row each. Only versions
whose columns or types differ are looked into. Renames come from an assignment
between the columns that went and those that came; how alike two names are is
learned from all versions: whether both ever stand in one, and how often one took
over from the other with like values.

Defined results: a version received twice is one version (the lower tie counts);
null and empty values have no type and make no change of type; the first version
of a source has no change; versions without source or order are left out; empty
tables give empty results; the order of columns and how a text is written are no
change.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions.attrs import Frac, Int, read_attrs
from ..session import cut

CHANGE = ArrayType(StructType([StructField("change_kind", StringType()), StructField("old_name", StringType()), StructField("new_name", StringType())]))
CANDIDATES = "array<struct<old:string,new:string,value:double,tells:double,exact:boolean>>"
WALKED = "row string, kind string, src string, chunk bigint, ord bigint, file string, sig string, payload string, n bigint"
MINIMA, SEEDS = 12, 4
CHUNK = 4096
JOINER = "\x1f"
LIKE = 0.5
AT_ONCE = 4096


# ---- profiles of versions


def bare_number(text: Column) -> Column:
    """The text without outer blanks, and without a tag of letters before a whole number (ch100)."""
    return F.regexp_replace(F.trim(text), r"^[A-Za-z]+[-_ ]?(?=\d+$)", "")


def attr_versions(df: DataFrame, source: str, order: str, tie: str, file: str, attrs: str) -> DataFrame:
    """Versions whose columns are the attributes of a JSON object."""
    # numbers of equal kind count as equal; an object that can't be told apart this way stands for itself
    kinds = F.regexp_replace(F.expr(f"schema_of_variant(try_parse_json(`{attrs}`))"), r"DOUBLE|DECIMAL\(\d+,[1-9]\d*\)|DECIMAL\((\d|1[0-8]),0\)", "D")
    names = F.array_join(F.array_sort(F.array_distinct(F.json_object_keys(attrs))), JOINER)
    return _versions(df, "proc", source, order, F.col(tie), F.col(file), F.coalesce(kinds, F.concat(F.lit("="), attrs), F.lit("")), names, F.col(attrs))


def cell_versions(df: DataFrame, source: str, order: str, file: str, row: str, cells: str) -> DataFrame:
    """Versions that are tables kept as rows of name-to-text maps, profiled inside (source, order), which one shuffle brings together.

    Sketch of a column: the least of 12 hashes over its filled (row, value)
    cells, and a digest of which rows share a value. Values are compared in one
    spelling: numbers as numbers, also behind a tag of letters (ch100).
    """
    rows = df.select(F.col(source).alias("src"), F.col(order).cast("bigint").alias("ord"), F.col(file).alias("file"), F.col(row).cast("bigint").alias("row"), F.col(cells).alias("cells")).filter("src is not null and ord is not null and cells is not null")
    rows = rows.repartition("src", "ord")
    files = rows.filter(F.size("cells") > 0).groupBy("src", "ord").agg(F.min("file").alias("file"))  # apart, as a text would keep the sums below from hashing
    each = rows.select("src", "ord", "row", F.explode("cells").alias("name", "text"))
    text = F.lower(F.trim("text"))
    each = each.select("src", "ord", "row", "name", F.when(text != "", text).alias("t"))
    rank = F.when(F.col("t").rlike(r"^[+-]?\d+$"), 0).when(F.col("t").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), 1).otherwise(F.when(F.col("t").isNotNull(), 2))
    bare = bare_number(F.col("t"))
    each = each.select("src", "ord", "name", rank.alias("rank"), F.coalesce(bare.try_cast("double").cast("string"), bare).alias("v"), F.xxhash64("row").alias("h"))
    each = each.withColumn("hv", F.when(F.col("v").isNotNull(), F.xxhash64("h", "v")))
    own = [F.min(F.hash("h", F.lit(i))).alias(f"c{i}") for i in range(SEEDS)] + [F.min(F.when(F.col("hv").isNotNull(), F.hash("hv", F.lit(i)))).alias(f"m{i}") for i in range(MINIMA)]
    values = each.groupBy("src", "ord", "name", "v").agg(F.max("rank").alias("rank"), F.count("v").alias("n"), *own)
    shared = F.bit_xor(F.when(F.col("v").isNotNull(), F.xxhash64(*[f"c{i}" for i in range(SEEDS)])))
    per = values.groupBy("src", "ord", "name").agg(F.max("rank").alias("rank"), F.sum("n").alias("filled"), F.count("v").alias("distinct"), shared.alias("classes"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(MINIMA)])
    kind = F.when(F.col("rank") == 0, "integer").when(F.col("rank") == 1, "fractional").when(F.col("rank") == 2, "text")
    column = F.struct("name", kind.alias("type"), "filled", "distinct", "classes", F.array(*[f"m{i}" for i in range(MINIMA)]).alias("minima"))
    sheets = per.groupBy("src", "ord").agg(F.sort_array(F.collect_list(column)).alias("columns")).join(files, ["src", "ord"])
    names = F.array_join(F.transform("columns", lambda c: c["name"]), JOINER)
    kinds = F.to_json(F.transform("columns", lambda c: F.struct(c["name"].alias("n"), c["type"].alias("t"))))
    return _versions(sheets, "sheet", "src", "ord", F.lit(0), F.coalesce("file", F.lit("")), kinds, names, F.to_json("columns"))


def _versions(df: DataFrame, kind: str, source: str, order: str, tie: Column, file: Column, sig: Column, names: Column, payload: Column) -> DataFrame:
    out = df.filter(F.col(source).isNotNull() & F.col(order).isNotNull())
    return out.select(F.lit(kind).alias("kind"), F.col(source).cast("string").alias("src"), F.col(order).cast("bigint").alias("ord"), tie.cast("bigint").alias("tie"), file.alias("file"), sig.alias("sig"), names.alias("names"), payload.alias("payload"))


def _value(value) -> tuple[str | None, str | None]:
    """Type of a JSON value, and its content in one spelling."""
    kind = "list" if isinstance(value, list) else "integer" if isinstance(value, Int | bool) else "fractional" if isinstance(value, Frac) else "text" if isinstance(value, str) and value.strip() else "object" if isinstance(value, dict) else None
    while isinstance(value, list) and len(value) == 1:
        value = value[0]
    if kind is None or value is None:
        return kind, None
    try:
        return kind, f"{float(str(value)):.12g}" if len(str(value)) < 13 else str(value)
    except ValueError:
        return kind, str(value)


@lru_cache(maxsize=1024)
def profiles(kind: str, payload: str | None) -> list[C.Profile]:
    """The columns of a version's payload."""
    if kind == "sheet":
        return [C.Profile(c["name"], c.get("type"), c["filled"], c["distinct"], tuple(m for m in c["minima"] if m is not None), c.get("classes")) for c in json.loads(payload or "[]")]
    found = [(k, *_value(v)) for k, v in read_attrs(payload).items()]
    return [C.Profile(k, t, int(v is not None), int(v is not None), value=v) for k, t, v in found]


# ---- changes between versions


def compared(kind: str, before: str | None, after: str | None) -> str:
    """What differs between two versions, and the candidates for renames, as JSON."""
    old, new = profiles(kind, before), profiles(kind, after)
    return json.dumps({"old": [[c.name, c.type] for c in old], "new": [[c.name, c.type] for c in new], "cands": [c._asdict() for c in C.candidates(old, new)]})


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of versions that differ, each chunk's first and last version, and how many versions have which names."""
    cols = [f.split()[0] for f in WALKED.split(", ")]
    types = [pa.int64() if f.endswith("bigint") else pa.string() for f in WALKED.split(", ")]
    out: list[tuple] = []
    seen: Counter = Counter()
    at, last = None, None

    def flush() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) or [[] for _ in cols]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=cols)

    def edge(row: str, key: tuple, version: tuple) -> None:
        order, file, sig, payload = version
        out.append((row, *key, order, file, sig, payload, None))

    for whole in batches:
        for lo in range(0, whole.num_rows, AT_ONCE):
            for kind, src, chunk, order, file, sig, names, payload in zip(*[c.to_pylist() for c in whole.slice(lo, AT_ONCE).columns], strict=True):
                key, version = (kind, src, chunk), (order, file, sig, payload)
                if key != at:
                    if at is not None:
                        edge("last", at, last)
                    edge("first", key, version)
                elif order == last[0]:
                    continue  # sent again
                elif sig != last[2]:
                    out.append(("pair", *key, order, file, None, compared(kind, last[3], payload), None))
                at, last = key, version
                seen[kind, names or ""] += 1
            if len(seen) > 100_000:
                out.extend(("names", k, None, None, None, None, None, names, n) for (k, names), n in seen.items())
                seen.clear()
            yield flush()
    if at is not None:
        edge("last", at, last)
    out.extend(("names", k, None, None, None, None, None, names, n) for (k, names), n in seen.items())
    yield flush()


@F.pandas_udf(StringType())
def _compared(kind: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([compared(*x) for x in zip(kind, before, after, strict=True)], dtype=object)


@F.pandas_udf(CHANGE)
def _settled(found: pd.Series, evidence: pd.Series) -> pd.Series:
    """The changes of each pair of versions: its candidates by the evidence on their names (together, expected, handed, compared)."""
    out = []
    for text, known in zip(found, evidence, strict=True):
        d = json.loads(text)
        scored = []
        by = {(e["a"], e["b"]): e for e in (known if known is not None else ())}
        for c in (C.Candidate(**c) for c in d["cands"]):
            e = by[min(c.old, c.new), max(c.old, c.new)]
            own = c.value is not None
            scored.append((c.old, c.new, C.likeness(c, e["together"], e["expected"], e["handed"] - (own and c.value >= LIKE), e["compared"] - own)))
        old, new = ([C.Profile(*x) for x in d[s]] for s in ("old", "new"))
        out.append([dict(zip(("change_kind", "old_name", "new_name"), x, strict=True)) for x in C.changes(old, new, C.renames(scored))])
    return pd.Series(out, dtype=object)


def _walked(versions: DataFrame, chunk: int) -> DataFrame:
    rows = versions.withColumn("chunk", F.floor(F.col("ord") / F.lit(chunk)).cast("bigint")).repartition("kind", "src", "chunk").sortWithinPartitions("kind", "src", "chunk", "ord", "tie", "payload")
    return cut(rows.select("kind", "src", "chunk", "ord", "file", "sig", "names", "payload").mapInArrow(_walk, WALKED))


def _pairs(walked: DataFrame) -> DataFrame:
    """(kind, src, ord, file, found) of all pairs of versions that differ, those over the edge of a chunk too."""
    inside = walked.filter("row = 'pair'").select("kind", "src", "ord", "file", F.col("payload").alias("found"))
    w = Window.partitionBy("kind", "src").orderBy("chunk", "row")  # 'first' before 'last'
    edges = walked.filter("row in ('first', 'last')").withColumn("p", F.lag(F.struct("sig", "payload")).over(w))
    edges = edges.filter("row = 'first' and p is not null and not p.sig <=> sig")
    return inside.unionByName(edges.select("kind", "src", "ord", "file", _compared("kind", "p.payload", "payload").alias("found")))


def name_sets(walked: DataFrame) -> DataFrame:
    """(kind, names, n): how many versions have exactly these column names."""
    return walked.filter("row = 'names'").groupBy("kind", "payload").agg(F.sum("n").alias("n")).select("kind", F.filter(F.split("payload", JOINER), lambda x: x != "").alias("names"), "n")


def names_together(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, name, n), and (kind, a, b, n) with a < b: versions with a name, and with two names. Counted over the distinct sets of names."""
    single = sets.select("kind", F.explode("names").alias("name"), "n").groupBy("kind", "name").agg(F.sum("n").alias("n"))
    firsts = sets.select("kind", "n", "names", F.explode("names").alias("a"))
    both = firsts.select("kind", "n", "a", F.explode(F.filter("names", lambda x: x > F.col("a"))).alias("b")).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return single, both


def changes_of(versions: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(kind, src, file, change_kind, old_name, new_name) of each version against the one before it; and the table of name sets."""
    walked = _walked(versions, chunk)
    pairs, sets = cut(_pairs(walked)), name_sets(walked)
    cands = pairs.select("kind", "src", "ord", F.explode(F.from_json(F.get_json_object("found", "$.cands"), CANDIDATES)).alias("c"))
    cands = cands.select("kind", "src", "ord", F.least("c.old", "c.new").alias("a"), F.greatest("c.old", "c.new").alias("b"), F.col("c.value").alias("v"))
    handed = cands.groupBy("kind", "a", "b").agg(F.count_if(F.col("v") >= LIKE).alias("handed"), F.count("v").alias("compared"))
    single, both = names_together(sets)
    one = lambda c: single.select("kind", F.col("name").alias(c), F.col("n").alias(f"n_{c}"))
    evidence = handed.join(one("a"), ["kind", "a"]).join(one("b"), ["kind", "b"]).join(both, ["kind", "a", "b"], "left").join(sets.groupBy("kind").agg(F.sum("n").alias("n_all")), "kind")
    evidence = evidence.select("kind", "a", "b", "handed", "compared", (F.coalesce("n", F.lit(0)) / F.least("n_a", "n_b")).alias("together"), (F.col("n_a") * F.col("n_b") / F.col("n_all")).alias("expected"))
    known = cands.select("kind", "src", "ord", "a", "b").join(evidence, ["kind", "a", "b"]).groupBy("kind", "src", "ord").agg(F.collect_list(F.struct("a", "b", "together", "expected", "handed", "compared")).alias("evidence"))
    settled = pairs.join(known, ["kind", "src", "ord"], "left").select("kind", "src", "file", F.inline(_settled("found", "evidence")))
    return settled, sets


def version_changes(versions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(kind, src, file, change_kind, old_name, new_name) of each version against the one before it in its source."""
    return changes_of(versions, chunk)[0]


# ---- one table


def column_families(changes: DataFrame, sets: DataFrame) -> dict[str, str]:
    """Name of each column to the name of its family, from all renames seen, however seldom, and all names.

    What reaches the driver are the distinct names, the pairs of names that were
    renames, and the pairs that stand together: as many as a vocabulary of column
    names has, whatever the data's size. Pairs seen most often join first; names
    that stand in one version stay apart, and so does what would bring them
    together. Names that no rename touches join a family by equal letters, if
    they never stand with it. A family is named by its most used name.
    """
    single, both = names_together(sets)
    used = {r["name"]: r["n"] for r in single.collect()}
    beside = {(r["a"], r["b"]): r["n"] for r in both.collect()}
    pairs = changes.filter("change_kind = 'renamed'").groupBy("old_name", "new_name").count().collect()
    members: dict[str, set[str]] = {n: {n} for n in used}

    def apart(a: str, b: str) -> bool:
        return any(beside.get((min(x, y), max(x, y)), 0) > C.TOGETHER * min(used[x], used[y]) for x in members[a] for y in members[b])

    def join(a: str, b: str) -> None:
        if members[a] is not members[b] and not apart(a, b):
            members[a] |= members[b]
            for n in members[b]:
                members[n] = members[a]

    for p in sorted(pairs, key=lambda p: (-p["count"], p["old_name"], p["new_name"])):
        join(p["old_name"], p["new_name"])
    for n in sorted(used, key=lambda n: (used[n], n)):
        if len(members[n]) == 1:
            for m in sorted(used, key=lambda m: (-used[m], m)):
                if m != n and C.name_likeness(n, m) == 1.0 and not apart(n, m):
                    join(m, n)
                    break
    return {n: min(members[n], key=lambda m: (-used[m], m)) for n in sorted(used)}


def column_types(values: DataFrame, families: dict[str, str]) -> dict[str, str]:
    """Unified type of each family, from all its filled values: bigint, double or string. ``values`` has one map of name to text."""
    (col,) = values.columns
    texts = values.select(F.explode(col).alias("name", "t")).filter(F.trim("t") != "").select("name", bare_number(F.col("t")).alias("t"))
    per = texts.groupBy("name").agg(F.bool_and(F.col("t").rlike(r"^[+-]?\d{1,18}$")).alias("whole"), F.bool_and(F.col("t").try_cast("double").isNotNull()).alias("number")).collect()
    kinds: dict[str, list] = {}
    for r in per:
        kinds.setdefault(families.get(r["name"], r["name"]), []).append("bigint" if r["whole"] else "double" if r["number"] else "string")
    rank = ("bigint", "double", "string")
    return {f: max(kinds[f], key=rank.index) if f in kinds else "string" for f in sorted(set(families.values()))}


def unified(values: Column, families: dict[str, str], types: dict[str, str]) -> list[Column]:
    """One column per family, of its unified type, from a name-to-text map: the first filled of its names, the family's own first."""
    alias = {f: [f, *sorted(k for k, v in families.items() if v == f and k != f)] for f in types}
    blank = lambda c: F.when(F.trim(c) != "", c)
    found = {f: F.coalesce(*[blank(F.try_element_at(values, F.lit(a))) for a in alias[f]]) for f in types}
    return [(c if types[f] == "string" else bare_number(c).cast(types[f])).alias(f) for f, c in found.items()]


def others(values: Column, families: dict[str, str]) -> Column:
    """The filled values beside the one that its family's column holds (a version with two names of one family), under their own names."""
    first = {f: [f, *sorted(k for k, v in families.items() if v == f and k != f)] for f in set(families.values())}
    many = {f: ns for f, ns in first.items() if len(ns) > 1}
    filled = F.map_filter(values, lambda k, v: F.trim(v) != "")
    if not many:
        return F.map_filter(filled, lambda k, v: F.lit(False))
    before = F.create_map(*[x for ns in many.values() for i, n in enumerate(ns) if i for x in (F.lit(n), F.array(*map(F.lit, ns[:i])))])
    return F.map_filter(filled, lambda k, v: F.arrays_overlap(F.coalesce(F.try_element_at(before, k), F.array().cast("array<string>")), F.map_keys(filled)))
