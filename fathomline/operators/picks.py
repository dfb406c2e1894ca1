"""Phase picks from per-sample scores, and where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("P", "S")


def peaks(score: Column, threshold: float) -> Column:
    """0-based indices of local maxima at or above a threshold; of a plateau its first sample counts."""
    lowest = F.array(F.lit(float("-inf")))
    before = F.concat(lowest, score)
    after = F.concat(F.slice(score, 2, 2_147_483_645), lowest)
    sides = F.zip_with(F.slice(before, F.lit(1), F.size(score)), after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.transform(F.zip_with(score, sides, lambda v, s: (v >= threshold) & (v > s["a"]) & (v >= s["b"])), lambda hit, i: F.when(hit, i))
    return F.array_compact(found)


def pick(df: DataFrame, channel: str, scores: dict[str, Column], threshold: float, fs: Column, begin_us: Column, keep: list[str] | None = None) -> DataFrame:
    """(keep, channel_index, phase_index, phase_type, phase_time_us, phase_score): one row per pick of each phase's scores."""
    parts = []
    for phase, score in scores.items():
        rows = df.select(*(keep or []), F.col(channel).alias("channel_index"), fs.alias("_fs"), begin_us.alias("_b"), score.alias("_s"))
        rows = rows.select("*", F.explode(peaks(F.col("_s"), threshold)).alias("phase_index"))
        parts.append(rows.select(*(keep or []), "channel_index", "phase_index", F.lit(phase).alias("phase_type"), (F.col("_b") + F.rint(F.col("phase_index") * F.lit(1e6) / F.col("_fs"))).cast("bigint").alias("phase_time_us"), F.get("_s", F.col("phase_index")).alias("phase_score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pick_counts(picks: DataFrame) -> DataFrame:
    return picks.groupBy("phase_type").agg(F.count("*").alias("n"))


def pick_seconds(index: Column, fs: Column, t0: Column) -> Column:
    """Where a pick is drawn: seconds from the trace's own origin."""
    return t0 + index / fs


def scored(df: DataFrame, channel: str, samples: str, keys: list[str], scorer, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Per-sample scores of a model: (keys, channel, <phase>: array<double>, ...).

    ``scorer`` maps a chunk's (channels, samples) matrix to (phases, channels,
    samples). A chunk of (keys) is what a model sees at once, so it goes to one
    task; its channels are bounded by the instrument.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*[StructField(k, df.schema[k].dataType) for k in keys], StructField(channel, df.schema[channel].dataType), *[StructField(p, ArrayType(DoubleType())) for p in phases]])

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows[samples].notna()].sort_values(channel)
        if not len(rows):
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema})
        scores = np.asarray(scorer(np.stack(rows[samples].to_list()).astype(np.float32)), float)
        out = {k: group[i] for i, k in enumerate(keys)} | {channel: rows[channel].to_numpy()} | {p: list(scores[i]) for i, p in enumerate(phases)}
        return pd.DataFrame(out)

    return df.select(*keys, channel, samples).groupBy(*keys).applyInPandas(run, schema)
