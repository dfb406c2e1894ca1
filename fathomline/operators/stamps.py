"""Mixed time stamps, settled per source by the cheapest path over its records.

Each stamp has an array of valid readings. A record's states are the
combinations of its stamps' readings, each with a cost from the readings and
from the record's own evidence (another time the record knows). Over the records
of a source, in their order, Viterbi's path pays for these, for switches of form
and for time that runs backwards.

A record with a single state cuts a path into two that don't know of each other,
so only the stretches of ambiguous records between such records are paths.
Sources are walked in chunks of their order, so that one with a third of all
rows is many tasks. What lies between two single states of a chunk is settled
there. A stretch that reaches a chunk's end is summed up as the cheapest costs
from each state of its first record to each of its last; these small matrices
are folded along the source, and the stretch is walked once more between the two
states found. So a path is the whole source's, wherever chunks end.

Defined results: stamps without reading come out null and are no part of a path;
sources, zones and orders may be null; repeated rows are records of their own;
of states and paths that tie, the one with the earlier state of the array holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import stamps as S
from ..session import cut

READING = StructType([StructField("form", StringType()), StructField("us", LongType()), StructField("cost", DoubleType())])
SWITCH, BACKWARD, AGAINST = 1.0, 3.0, 50.0

WALKED = "row string, src string, chunk bigint, part int, rec bigint, us array<bigint>, keep array<string>, body string"
State = tuple[tuple, list, float]  # forms, times, cost


def readings(stamp: Column, tz: Column) -> Column:
    """All valid readings of a stamp as array<struct<form, us, cost>>."""

    @F.pandas_udf(ArrayType(READING))
    def read(texts: pd.Series, zones: pd.Series) -> pd.Series:
        return pd.Series([[{"form": f, "us": u, "cost": c} for f, u, c in S.readings(t, z)] for t, z in zip(texts, zones, strict=True)], dtype=object)

    return read(stamp, tz)


def _or_null(found: Column) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast(READING)))


def single_states(found: Column, cost) -> Column:
    """States of records with one stamp; ``cost`` maps the reading's time to its evidence cost."""
    return F.transform(_or_null(found), lambda r: F.struct(F.array(r["form"]).alias("forms"), F.array(r["us"]).alias("us"), (F.coalesce(r["cost"], F.lit(0.0)) + F.coalesce(cost(r["us"]), F.lit(0.0))).alias("cost")))


def paired_states(first: Column, second: Column, cost) -> Column:
    """States of records with two stamps: all pairs of their readings."""
    own = lambda r: F.coalesce(r["cost"], F.lit(0.0))
    pairs = F.transform(_or_null(first), lambda a: F.transform(_or_null(second), lambda b: F.struct(F.array(a["form"], b["form"]).alias("forms"), F.array(a["us"], b["us"]).alias("us"), (own(a) + own(b) + F.coalesce(cost(a["us"], b["us"]), F.lit(0.0))).alias("cost"))))
    return F.flatten(pairs)


def settle(df: DataFrame, record: str, source: Column, chunk: Column, order: Column, states: Column, keep: Column) -> DataFrame:
    """(record, us, keep): the chosen reading of each of the record's stamps; ``keep``, an array of text, comes along.

    ``chunk`` must follow ``order`` within the source; where chunks end changes no result.
    """
    rows = df.select(F.col(record).alias("rec"), source.cast("string").alias("src"), F.coalesce(chunk.cast("bigint"), F.lit(-(1 << 62))).alias("chunk"), order.alias("ord"), states.alias("states"), keep.alias("keep"))
    rows = rows.repartition("src", "chunk").sortWithinPartitions("src", "chunk", "ord", "rec")
    walked = cut(rows.select("rec", "src", "chunk", "states", "keep").mapInPandas(_walk, WALKED))
    unsettled = walked.filter("row = 'open'").select(F.col("src").alias("_src")).distinct()
    parts = walked.filter("row = 'part'")
    ends = parts.join(unsettled, parts["src"].eqNullSafe(unsettled["_src"]), "left_semi").select("src", "chunk", "part", "body").groupBy("src").applyInPandas(_fold, "src string, chunk bigint, part int, first int, last int")
    stretch = walked.filter("row = 'open'").select("src", "chunk", "part", "rec", "keep", "body")
    held = (stretch["src"].eqNullSafe(ends["src"])) & (stretch["chunk"] == ends["chunk"]) & (stretch["part"] == ends["part"])
    late = stretch.join(ends, held).select(stretch["src"], stretch["chunk"], stretch["part"], "rec", "keep", "body", "first", "last")
    late = late.groupBy("src", "chunk", "part").applyInPandas(_finish, "rec bigint, us array<bigint>, keep array<string>")
    out = walked.filter("row = 'done'").select("rec", "us", "keep").unionByName(late)
    return out.select(F.col("rec").alias(record), "us", "keep")


def _states(raw) -> list[State]:
    return [(tuple(s["forms"]), [None if pd.isna(u) else int(u) for u in s["us"]], float(s["cost"])) for s in raw]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settled records; of each chunk's first and last stretch (parts 0 and 1; 2 if it is the whole chunk) the records and their matrix."""
    out: list[tuple] = []
    key, part, stretch = None, 0, []  # stretch: records since the last single state, this one first

    def done(recs: list, path: list) -> None:
        out.extend(("done", None, None, None, rec, us, keep, None) for (rec, keep, _), us in zip(recs, path, strict=True))

    def close(last: bool) -> None:
        """Settles the stretch, or leaves it open if it reaches an end of the chunk."""
        if part == 1 and not last:
            done(stretch[:-1], cheapest_path([s for _, _, s in stretch])[:-1])
            return
        at = (*key, 2 if part == 0 and last else part)
        body = [s for _, _, s in stretch]
        out.append(("part", *at, None, None, None, json.dumps([body[0], body[-1], through(body)])))
        if all(len(s) == 1 for s in body):
            done(stretch[: None if last else -1], [s[0][1] for s in body[: None if last else -1]])
        else:
            # the single state that ends a part is settled by the part it begins
            out.extend(("open", *at, rec, None, keep, json.dumps([i, last or i < len(stretch) - 1, s])) for i, (rec, keep, s) in enumerate(stretch))

    def frame() -> pd.DataFrame:
        names = [c.split()[0] for c in WALKED.split(", ")]
        f = pd.DataFrame(out, columns=names, dtype=object)
        out.clear()
        return f.astype({"chunk": "Int64", "part": "Int32", "rec": "Int64"})

    for batch in batches:
        for rec, src, chunk, raw, keep in zip(batch["rec"], batch["src"], batch["chunk"], batch["states"], batch["keep"], strict=True):
            states = _states(raw)
            if len(states) == 1 and all(u is None for u in states[0][1]):
                out.append(("done", None, None, None, rec, states[0][1], keep, None))
                continue
            if (src, chunk) != key:
                if stretch:
                    close(True)
                key, part, stretch = (src, chunk), 0, []
            stretch.append((rec, keep, states))
            if len(states) == 1:
                if part == 1 and len(stretch) == 2:
                    done(stretch[:1], [stretch[0][2][0][1]])
                else:
                    close(False)
                part, stretch = 1, stretch[-1:]
        yield frame()
    if stretch:
        close(True)
    yield frame()


def through(records: list[list[State]]) -> list[list[float]]:
    """Cheapest cost from each state of the first record to each state of the last, both ends' own costs included."""
    table = [[s[2] if i == j else float("inf") for j, s in enumerate(records[0])] for i in range(len(records[0]))]
    for before, here in zip(records, records[1:], strict=False):
        steps = [[_step(b[0], b[1], h[0], h[1]) + h[2] for h in here] for b in before]
        table = [[min(c + steps[k][j] for k, c in enumerate(row)) for j in range(len(here))] for row in table]
    return table


def _fold(parts: pd.DataFrame) -> pd.DataFrame:
    """First and last state of each open part on the cheapest path over all parts of a source, one small matrix each."""
    rows = parts.sort_values(["chunk", "part"])
    keys = list(zip(rows["chunk"], rows["part"], strict=True))
    bodies = [json.loads(b) for b in rows["body"]]
    best: list[float] = []
    back: list[tuple[list[int], list[int]]] = []  # per part: the state before it for each first state, the first state for each last one
    for i, (first, _, table) in enumerate(bodies):
        if i == 0:
            enter, came = [0.0] * len(first), [0] * len(first)
        elif keys[i][1] == 1 and keys[i - 1][0] == keys[i][0]:
            enter, came = [best[0]], [0]  # between a chunk's two parts all is settled, and both of their states are single
        else:
            before = bodies[i - 1][1]
            steps = [[b + _step(s[0], s[1], f[0], f[1]) for b, s in zip(best, before, strict=True)] for f in first]
            came = [min(range(len(x)), key=x.__getitem__) for x in steps]
            enter = [x[c] for x, c in zip(steps, came, strict=True)]
        total = [[e + row[j] for e, row in zip(enter, table, strict=True)] for j in range(len(table[0]))]
        start = [min(range(len(x)), key=x.__getitem__) for x in total]
        best = [x[s] for x, s in zip(total, start, strict=True)]
        best = [b - min(best) for b in best]
        back.append((came, start))
    j = min(range(len(best)), key=best.__getitem__)
    chosen = []
    for came, start in reversed(back):
        i = start[j]
        chosen.append((i, j))
        j = came[i]
    found = pd.DataFrame(chosen[::-1], columns=["first", "last"])
    return pd.DataFrame({"src": rows["src"].to_numpy(), "chunk": [c for c, _ in keys], "part": [p for _, p in keys], "first": found["first"], "last": found["last"]})


def _finish(rows: pd.DataFrame) -> pd.DataFrame:
    """An open stretch of a chunk, walked between the two states it begins and ends with."""
    rows = rows.assign(_at=[json.loads(t)[0] for t in rows["body"]]).sort_values("_at")
    items = [json.loads(t) for t in rows["body"]]
    records = [[(tuple(f), u, c) for f, u, c in states] for _, _, states in items]
    first, last = int(rows["first"].iloc[0]), int(rows["last"].iloc[0])
    inf = float("inf")
    records[0] = [(f, u, c if k == first else inf) for k, (f, u, c) in enumerate(records[0])]
    if len(records) > 1:
        records[-1] = [(f, u, c if k == last else inf) for k, (f, u, c) in enumerate(records[-1])]
    path = cheapest_path(records)
    own = [bool(o) for _, o, _ in items]
    keep = [k for k, o in zip(rows["keep"], own, strict=True) if o]
    return pd.DataFrame({"rec": pd.array([r for r, o in zip(rows["rec"], own, strict=True) if o], dtype="Int64"), "us": pd.Series([p for p, o in zip(path, own, strict=True) if o], dtype=object), "keep": pd.Series(keep, dtype=object)})


def cheapest_path(records: list[list[State]]) -> list[list]:
    """Viterbi over records; each has states (forms, times, cost). The chosen times of each record."""
    if not records:
        return []
    best = [[s[2] for s in records[0]]]
    back: list[list[int]] = []
    for before, here in zip(records, records[1:], strict=False):
        costs, froms = [], []
        for forms, us, cost in here:
            steps = [c + _step(b[0], b[1], forms, us) for c, b in zip(best[-1], before, strict=True)]
            i = min(range(len(steps)), key=steps.__getitem__)
            costs.append(steps[i] + cost)
            froms.append(i)
        low = min(costs)
        best.append([c - low for c in costs])
        back.append(froms)
    i = min(range(len(best[-1])), key=best[-1].__getitem__)
    chosen = [i]
    for froms in reversed(back):
        i = froms[i]
        chosen.append(i)
    return [states[j][1] for states, j in zip(records, reversed(chosen), strict=True)]


def _step(forms0, us0: list, forms1, us1: list) -> float:
    cost = 0.0
    for f0, u0, f1, u1 in zip(forms0, us0, forms1, us1, strict=True):
        if u0 is not None and u1 is not None:
            cost += SWITCH * (f0 != f1) + BACKWARD * (u1 < u0)
    return cost
