"""Queries of the engine's own operators, over the driver's tables.

``embeddings`` stands in for recorded channels (one row a channel, its label the
chunk, 100 Hz), ``das_catalog`` and ``events`` for catalogs of files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as K
from ..functions import series as S
from ..functions.filters import bandpass, downsample
from ..functions.paths import canonical_path
from ..functions.spectral import xcorr
from ..operators import catalog as C
from ..operators import channels as H
from ..operators import joins as J
from ..operators import picks as P
from ..operators import traces as T
from ..operators.times import resolve_times
from ..plans import events as E
from ..plans import noise as N
from ..plans.desample import desample
from ..plans.desample import desample_windows as desampled
from ..session import table
from .catalog_problems import PATHS, RESOLVED

DT, FS, T0 = 0.01, 100.0, -0.2
BEGIN_US = 1_700_000_000_000_000
ORDER = [*C.ORDER, "row_id"]
MINUTE_US = 60_000_000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("channel"), F.col("label").alias("chunk"), F.col("embedding").alias("samples"), F.lit(DT).alias("dt"), F.lit(FS).alias("fs"), F.lit(1.0).alias("dx"), F.lit(T0).alias("t0_sec"), F.lit(BEGIN_US).alias("begin_us"))


def _long(traces: DataFrame, samples: Column, digits: int = 6) -> DataFrame:
    out = traces.select("channel", F.posexplode(samples).alias("it", "y"))
    return out.select("channel", "it", (F.round(F.col("y").cast("double"), digits) + 0.0).alias("y"))


S_SQL = "s AS (SELECT vec_id AS channel, label AS chunk, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INT) AS it, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
W_SQL = "WINDOW w AS (PARTITION BY channel ORDER BY it)"


@query(f"WITH {S_SQL} SELECT channel, it, round(x, 6) + 0.0 AS y FROM s")
def trace_explode(spark, sf):
    return _long(_traces(spark, sf), F.col("samples"))


@query(f"WITH {S_SQL} SELECT channel, it, round(CAST(-0.2 + it * 0.01 AS DOUBLE), 6) AS t_sec, 1700000000000000 + it * 10000 AS t_us FROM s")
def time_axes(spark, sf):
    rows = T.to_samples(_traces(spark, sf), ["channel", "dt", "t0_sec", "begin_us"])
    return rows.select("channel", "it", F.round(T.time_axis(F.col("it"), F.col("t0_sec"), F.col("dt")), 6).alias("t_sec"), T.clock_axis(F.col("it"), F.col("begin_us"), F.col("dt")).alias("t_us"))


@query(f"WITH {S_SQL} SELECT channel, CAST(it - 15 AS INT) AS it, round(x, 6) + 0.0 AS y FROM s WHERE channel >= 10 AND channel < 200 AND it >= 15 AND it < 40")
def truncate(spark, sf):
    cut = T.truncate(_traces(spark, sf), (10, 200), (-0.05, 0.2))
    return _long(cut, F.col("samples"))


@query(f"WITH {S_SQL}, wanted(position, channel) AS (VALUES (0, 7), (1, 3), (2, 3), (3, 11)) SELECT CAST(position AS INT) AS position, it, round(x, 6) + 0.0 AS y FROM s JOIN wanted USING (channel)")
def select_channels(spark, sf):
    rows = T.select_channels(_traces(spark, sf), [7, 3, 3, 11])
    return rows.select("position", F.posexplode("samples").alias("it", "x")).select("position", "it", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("y"))


@query("SELECT vec_id AS channel, 4.0::DOUBLE AS dx FROM embeddings WHERE vec_id % 4 = 0")
def skip_ch(spark, sf):
    return T.skip_channels(_traces(spark, sf), 4).select("channel", "dx")


@query(f"WITH {S_SQL} SELECT channel, CAST(it // 5 AS INT) AS it, round(x, 6) + 0.0 AS y FROM s WHERE it % 5 = 0")
def skip_t(spark, sf):
    return _long(T.skip_samples(_traces(spark, sf), 5), F.col("samples"))


@query(f"WITH {S_SQL} SELECT channel, it, round(x * 1.1, 6) + 0.0 AS y, 'strain/s' AS unit FROM s")
def to_physical(spark, sf):
    rows = _traces(spark, sf).withColumns({"unit": F.lit("radian/s"), "factor": F.lit(1.1)})
    out = rows.select("channel", "unit", F.posexplode(K.to_physical(F.col("samples"), F.col("unit"), F.col("factor"))).alias("it", "x"))
    return out.select("channel", "it", (F.round("x", 6) + 0.0).alias("y"), K.physical_unit(F.col("unit")).alias("unit"))


@query("""WITH u AS (SELECT trace_id, replace(lower(units), '/sec', '/s') AS t FROM das_traces)
  SELECT trace_id, CASE WHEN contains(t, 'microstrain/s') THEN 'microstrain/s' WHEN contains(t, 'microstrain') THEN 'microstrain' WHEN contains(t, 'strain/s') THEN 'strain/s' WHEN contains(t, 'strain') THEN 'strain'
    WHEN contains(t, 'radian/s') THEN 'radian/s' WHEN contains(t, 'radian') THEN 'radian' WHEN contains(t, 'count') THEN 'count' ELSE 'unknown' END AS unit FROM u""")
def unit_normalize(spark, sf):
    return table(spark, sf, "das_traces").select("trace_id", K.normalize_unit(F.col("units")).alias("unit"))


@query(f"""WITH {S_SQL}, m AS (SELECT channel, avg(x) AS mx, avg(it) AS mi, regr_slope(x, it) AS b FROM s GROUP BY channel)
  SELECT channel, it, round(x - (mx + b * (it - mi)), 6) + 0.0 AS y FROM s JOIN m USING (channel)""")
def detrend(spark, sf):
    return _long(_traces(spark, sf), S.detrend(F.col("samples")))


@query(f"""WITH {S_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM s), t AS (SELECT *, 0.4 * (n - 1) AS a FROM n)
  SELECT channel, it, round(x * CASE WHEN it <= floor(a / 2) THEN 0.5 * (1 + cos(pi() * (-1 + 2.0 * it / a))) WHEN it >= n - floor(a / 2) - 1 THEN 0.5 * (1 + cos(pi() * (-2.0 / 0.4 + 1 + 2.0 * it / a))) ELSE 1.0 END, 6) + 0.0 AS y FROM t""")
def taper(spark, sf):
    return _long(_traces(spark, sf), S.taper(F.col("samples"), 0.4))


@query(f"WITH {S_SQL} SELECT channel, it, round(coalesce((x - lag(x) OVER w) / 0.01, 0), 5) + 0.0 AS y FROM s {W_SQL}")
def diff(spark, sf):
    return _long(_traces(spark, sf), S.backward_difference(F.col("samples"), F.col("dt")), 5)


@query(f"""WITH {S_SQL} SELECT channel, it, round(CASE WHEN lag(x) OVER w IS NULL THEN (lead(x) OVER w - x) / 0.01 WHEN lead(x) OVER w IS NULL THEN (x - lag(x) OVER w) / 0.01
  ELSE (lead(x) OVER w - lag(x) OVER w) / (2 * 0.01) END, 5) + 0.0 AS y FROM s {W_SQL}""")
def gradient(spark, sf):
    return _long(_traces(spark, sf), S.gradient(F.col("samples"), F.col("dt")), 5)


@query(f"WITH {S_SQL} SELECT channel, it, round(CASE WHEN it = 0 THEN 0 ELSE 0.01 * sum(x) OVER w END, 6) + 0.0 AS y FROM s {W_SQL}")
def integrate(spark, sf):
    return _long(_traces(spark, sf), S.integrate(DT)(S.doubles(F.col("samples"))))


# counts that roll over: positions times a step, taken modulo 2**32 into the signed range
ROLLED = 1_500_000_000.0


@query(f"""WITH {S_SQL}, r AS (SELECT channel, it, x * 1000 + it * {ROLLED} AS v FROM s), c AS (SELECT channel, it, v - 4294967296.0 * floor((v + 2147483648.0) / 4294967296.0) AS c FROM r),
  d AS (SELECT *, c - lag(c) OVER w AS d FROM c {W_SQL})
  SELECT channel, it, round(c + coalesce(sum(CASE WHEN d > 2147483648.0 THEN -4294967296.0 WHEN d < -2147483648.0 THEN 4294967296.0 ELSE 0.0 END) OVER w, 0), 2) + 0.0 AS y FROM d {W_SQL}""")
def unwrap(spark, sf):
    v = F.transform("samples", lambda x, i: x.cast("double") * 1000 + i * ROLLED)
    counts = F.transform(v, lambda y: y - 4294967296.0 * F.floor((y + 2147483648.0) / 4294967296.0))
    return _long(_traces(spark, sf), S.unwrap()(counts), 2)


@query(f"WITH {S_SQL} SELECT channel, it, CAST(sign(x) AS DOUBLE) + 0.0 AS y FROM s")
def one_bit(spark, sf):
    return _long(_traces(spark, sf), S.one_bit(F.col("samples")))


@query(f"""WITH {S_SQL}, e AS (SELECT *, sum(abs(x)) OVER (PARTITION BY channel ORDER BY it ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS inner_sum,
    first_value(abs(x)) OVER (PARTITION BY channel ORDER BY it) AS x0, first_value(abs(x)) OVER (PARTITION BY channel ORDER BY it DESC) AS xn, count(*) OVER (PARTITION BY channel) AS n FROM s),
  v AS (SELECT *, (inner_sum + greatest(0, 2 - it) * x0 + greatest(0, 1 - (n - 1 - it)) * xn) / 4 AS env FROM e)
  SELECT channel, it, round(CASE WHEN env > 0 THEN x / env ELSE 0 END, 5) + 0.0 AS y FROM v""")
def ram_norm(spark, sf):
    return _long(_traces(spark, sf), S.running_abs_mean(4)(S.doubles(F.col("samples"))), 5)


def _samples(traces: DataFrame) -> DataFrame:
    return T.to_samples(traces, ["chunk", "channel"]).withColumn("x", F.col("x").cast("double"))


@query(f"WITH {S_SQL}, m AS (SELECT chunk, it, median(x) AS m FROM s GROUP BY chunk, it) SELECT channel, s.it, round(x - m, 6) + 0.0 AS y FROM s JOIN m ON s.chunk = m.chunk AND s.it = m.it")
def common_mode(spark, sf):
    rows = T.block_samples(T.subtract_common_mode(_traces(spark, sf), "chunk"), ["channel"])
    return rows.select("channel", "it", (F.round("x", 6) + 0.0).alias("y"))


@query(f"""WITH {S_SQL}, f AS (SELECT channel, avg(x) AS mx, avg(it) AS mi, regr_slope(x, it) AS b FROM s GROUP BY channel),
  d AS (SELECT chunk, channel, it, x - (mx + b * (it - mi)) AS y FROM s JOIN f USING (channel)), m AS (SELECT chunk, it, median(y) AS m FROM d GROUP BY chunk, it)
  SELECT d.channel, round(sqrt(avg((y - m) * (y - m))), 6) AS rms FROM d JOIN m ON d.chunk = m.chunk AND d.it = m.it GROUP BY d.channel""")
def detrend_cm_rms(spark, sf):
    flat = _traces(spark, sf).withColumn("samples", S.detrend(F.col("samples")))
    rows = T.block_samples(T.subtract_common_mode(flat, "chunk"), ["channel"])
    return rows.groupBy("channel").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"))


@query(f"WITH {S_SQL} SELECT chunk, round(quantile_cont(abs(x), 0.995), 6) AS clim FROM s GROUP BY chunk")
def clim_percentile(spark, sf):
    return _samples(_traces(spark, sf)).groupBy("chunk").agg(F.round(F.percentile(F.abs("x"), F.lit(0.995)), 6).alias("clim"))


@query(f"WITH {S_SQL} SELECT channel, it, round(x / greatest(max(abs(x)) OVER (PARTITION BY channel), 1e-30), 6) + 0.0 AS y FROM s")
def wiggle_norm(spark, sf):
    return _long(_traces(spark, sf), S.peak_scaled(F.col("samples")))


def _butterworth(f: float, poles: int, high_pass: bool = False) -> list[tuple[float, ...]]:
    """Sections (b0, b1, b2, a1, a2) with the corner at ``f`` cycles per sample, by the textbook's w = 2 tan(pi f) and s = 2 (1 - z) / (1 + z)."""
    w = 2 * math.tan(math.pi * f)
    out = [(w / (2 + w), w / (2 + w), 0.0, (w - 2) / (w + 2), 0.0)] if poles % 2 else []
    for k in range(poles // 2):
        damp = 4 * w * math.sin(math.pi * (2 * k + 1) / (2 * poles))
        a0 = 4 + damp + w * w
        b = (4.0, -8.0, 4.0) if high_pass else (w * w, 2 * w * w, w * w)
        out.append((*(v / a0 for v in b), (2 * w * w - 8) / a0, (4 - damp + w * w) / a0))
    return out


def _recursion(*filters: list[tuple[float, ...]], step: int = 1) -> str:
    """Each filter's sections forward, then backward, from rest, as recursions over the samples; every ``step``-th sample of the result."""
    ctes, src = [S_SQL, "n AS (SELECT channel, max(it) AS top FROM s GROUP BY channel)"], "s"
    for i, sections in enumerate(filters):
        for way in ("ahead", "back"):
            for k, (b0, b1, b2, a1, a2) in enumerate(sections):
                name = f"{way}{i}_{k}"
                value = f"({b0!r}) * n.x + ({b1!r}) * p.x1 + ({b2!r}) * p.x2 - ({a1!r}) * p.y1 - ({a2!r}) * p.y2"
                ctes.append(f"""{name} AS (SELECT channel, it, ({b0!r}) * x AS y1, 0.0::DOUBLE AS y2, x AS x1, 0.0::DOUBLE AS x2 FROM {src} WHERE it = 0
      UNION ALL SELECT n.channel, n.it, {value}, p.y1, n.x, p.x1 FROM {name} p JOIN {src} n ON n.channel = p.channel AND n.it = p.it + 1)""")
                turn = k == len(sections) - 1
                ctes.append(f"of_{name} AS (SELECT channel, {'CAST(top - it AS INT)' if turn else 'it'} AS it, y1 AS x FROM {name} JOIN n USING (channel))")
                src = f"of_{name}"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT channel, CAST(it // {step} AS INT) AS it, round(x, 6) + 0.0 AS y FROM {src} WHERE it % {step} = 0"


@query(_recursion(_butterworth(0.1, 2)))
def lowpass_o4(spark, sf):
    return _long(_traces(spark, sf), bandpass(0.0, 10.0, DT, order=4)(S.doubles(F.col("samples"))))


@query(_recursion(_butterworth(0.02, 2, True), _butterworth(0.1, 2)))
def bandpass_o4(spark, sf):
    return _long(_traces(spark, sf), bandpass(2.0, 10.0, DT, order=4)(S.doubles(F.col("samples"))))


@query(_recursion(_butterworth(0.08, 4), step=5))
def downsample_aa(spark, sf):
    return _long(_traces(spark, sf), downsample(5, DT)(S.doubles(F.col("samples"))))


@query(_recursion(_butterworth(0.04, 7), step=10))
def desample_lowpass(spark, sf):
    return _long(_traces(spark, sf), desample(S.doubles(F.col("samples")), FS, 4.0))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_times(table(spark, sf, "das_catalog")).filter("run_id is not null and b_us is not null").withColumnsRenamed({"b_us": "begin_us", "e_us": "end_us"})


def _segmented(spark: SparkSession, sf: str) -> DataFrame:
    return C.segments(_catalog(spark, sf), "run_id", order=ORDER)


SEG = f"""{RESOLVED},
cat AS (SELECT *, b_us AS begin_us, e_us AS end_us FROM resolved WHERE run_id IS NOT NULL AND b_us IS NOT NULL),
lagged AS (SELECT *, lag(begin_us) OVER w AS pb, lag(end_us) OVER w AS pe, lag(fs) OVER w AS pf, lag(nx) OVER w AS pn, lag(file) OVER w AS pfile, row_number() OVER w AS rn
  FROM cat WINDOW w AS (PARTITION BY run_id ORDER BY begin_us, file, first_sample, row_id)),
spaced AS (SELECT *, CASE WHEN pf > 0 AND NOT isnan(pf) THEN 1 / pf ELSE 0 END AS sp, (begin_us - pe) / 1e6 AS step FROM lagged),
broken AS (SELECT *, CASE WHEN rn = 1 THEN 0 WHEN coalesce(fs <> pf OR isnan(fs) OR isnan(pf), TRUE) OR coalesce(nx <> pn, TRUE) OR coalesce(file = pfile, FALSE)
  OR NOT coalesce(abs(step - sp) <= 1.5 * sp + 1e-5 * abs(sp), FALSE) THEN 1 ELSE 0 END AS br FROM spaced),
seg AS (SELECT *, CAST(sum(br) OVER (PARTITION BY run_id ORDER BY rn) AS BIGINT) AS segment_id FROM broken),
segtab AS (SELECT run_id, segment_id, min(begin_us) AS begin_us, max(end_us) AS end_us, count(*) AS n_rows FROM seg GROUP BY ALL)"""


@query(f"WITH {SEG} SELECT row_id, segment_id FROM seg")
def segments(spark, sf):
    return _segmented(spark, sf).select("row_id", "segment_id")


@query(f"WITH {SEG} SELECT run_id, count(DISTINCT segment_id) AS n_segments, count(*) AS n_files, min(begin_us) AS first_us, max(end_us) AS last_us FROM seg GROUP BY run_id")
def n_segments(spark, sf):
    return _segmented(spark, sf).groupBy("run_id").agg(F.countDistinct("segment_id").alias("n_segments"), F.count("*").alias("n_files"), F.min("begin_us").alias("first_us"), F.max("end_us").alias("last_us"))


@query(f"WITH {SEG} SELECT * FROM segtab")
def timeline(spark, sf):
    return C.segment_table(_segmented(spark, sf), "run_id")


@query(f"""WITH {SEG}, nexts AS (SELECT *, lead(begin_us) OVER (PARTITION BY run_id ORDER BY begin_us, segment_id) AS nb FROM segtab)
  SELECT run_id, segment_id, end_us AS gap_from_us, nb AS gap_to_us FROM nexts WHERE nb > end_us""")
def timeline_gaps(spark, sf):
    return C.segment_gaps(C.segment_table(_segmented(spark, sf), "run_id"), "run_id")


def _windows(rows: DataFrame) -> DataFrame:
    """One window per run: from one to six minutes after its first sample."""
    return rows.groupBy("run_id").agg((F.min("begin_us") + MINUTE_US).alias("window_begin"), (F.min("begin_us") + 6 * MINUTE_US).alias("window_end"))


WIN = f"{SEG}, win AS (SELECT run_id, min(begin_us) + 60000000 AS wb, min(begin_us) + 360000000 AS we FROM cat GROUP BY run_id)"


@query(f"""WITH {WIN}, hits AS (SELECT seg.*, coalesce(begin_us < we AND end_us > wb, FALSE) AS hit FROM seg JOIN win USING (run_id)),
  near AS (SELECT *, lead(hit) OVER w AS nh, lag(hit) OVER w AS ph FROM hits WINDOW w AS (PARTITION BY run_id, segment_id ORDER BY begin_us, file, first_sample, row_id))
  SELECT row_id, segment_id, CASE WHEN hit THEN 'target' WHEN nh THEN 'before' ELSE 'after' END AS role FROM near WHERE hit OR nh OR ph""")
def select_window_pad(spark, sf):
    rows = _segmented(spark, sf)
    return C.select_window(rows, _windows(_catalog(spark, sf)), "run_id", order=ORDER).select("row_id", "segment_id", "role")


@query(f"""WITH {WIN}, hit AS (SELECT seg.* EXCLUDE (fs, nt, n, sp, step), rate AS fs, n AS nt, wb, we FROM seg JOIN win USING (run_id) WHERE begin_us < we AND end_us > wb),
  clip AS (SELECT *, greatest(begin_us, wb) AS lo, least(begin_us + nt * (1e6 / fs), CAST(we AS DOUBLE)) AS hi FROM hit),
  cnt AS (SELECT *, CAST(round_even((lo - begin_us) / (1e6 / fs), 0) AS BIGINT) AS off, CAST(round_even((hi - lo) / (1e6 / fs), 0) AS BIGINT) AS n_samples FROM clip),
  kept AS (SELECT *, lo + n_samples * (1e6 / fs) AS stop FROM cnt WHERE n_samples > 0),
  prev AS (SELECT *, lag(stop) OVER w AS ps, lag(segment_id) OVER w AS pseg FROM kept WINDOW w AS (PARTITION BY run_id ORDER BY begin_us, file, first_sample, row_id))
  SELECT row_id, first_sample + off AS sample_from, n_samples, CASE WHEN pseg <> segment_id THEN greatest(CAST(round_even((lo - ps) / (1e6 / fs), 0) AS BIGINT), 0) ELSE 0 END AS zeros_before FROM prev""")
def read_plan(spark, sf):
    rows = _segmented(spark, sf).drop("fs", "nt").withColumnsRenamed({"rate": "fs", "n": "nt"})
    return C.read_plan(rows, _windows(_catalog(spark, sf)), "run_id", order=ORDER).select("row_id", "sample_from", "n_samples", "zeros_before")


DEDUP = """first AS (SELECT run_id, channel, begin_time, min(trace_id) AS trace_id FROM das_traces WHERE samples IS NOT NULL AND len(samples) > 0 AND begin_time IS NOT NULL AND fs > 0 GROUP BY ALL),
blk AS (SELECT t.run_id, t.channel, epoch_us(t.begin_time) AS b, t.fs, len(t.samples) AS n, t.samples FROM das_traces t JOIN first USING (trace_id))"""


def _first_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of each channel of a run, those sent twice once."""
    t = table(spark, sf, "das_traces").filter("samples is not null and size(samples) > 0 and begin_time is not null and fs > 0").withColumn("b", F.unix_micros("begin_time"))
    return t.groupBy("run_id", "channel", "b").agg(F.min_by(F.struct("fs", "samples"), "trace_id").alias("r")).select("run_id", "channel", "b", "r.*")


@query(f"""WITH {DEDUP},
  gap AS (SELECT *, coalesce(greatest(CAST(round_even((b - lag(b + n * (1e6 / fs)) OVER w) / (1e6 / fs), 0) AS BIGINT), 0), 0) AS gap FROM blk WINDOW w AS (PARTITION BY run_id, channel ORDER BY b)),
  placed AS (SELECT *, sum(gap + n) OVER (PARTITION BY run_id, channel ORDER BY b) AS upto FROM gap)
  SELECT run_id, channel, CAST(max(upto) AS BIGINT) AS n_samples, CAST(sum(gap) AS BIGINT) AS n_zeros FROM placed GROUP BY ALL""")
def read_fill_gap(spark, sf):
    """Every channel of a run as one series, zeros between its blocks; shown by its lengths."""
    first = _first_blocks(spark, sf)
    rows = T.layout(first, ["run_id", "channel"], "b", "fs")
    return rows.groupBy("run_id", "channel").agg(F.max(F.col("_at") + F.col("_n")).alias("n_samples"), F.sum("_gap").alias("n_zeros"))


@query(f"""WITH {DEDUP},
  gap AS (SELECT *, coalesce(greatest(CAST(round_even((b - lag(b + n * (1e6 / fs)) OVER w) / (1e6 / fs), 0) AS BIGINT), 0), 0) AS gap FROM blk WINDOW w AS (PARTITION BY run_id, channel ORDER BY b)),
  placed AS (SELECT *, sum(gap + n) OVER (PARTITION BY run_id, channel ORDER BY b) - n AS pos FROM gap),
  held AS (SELECT run_id, channel, CAST(pos + unnest(range(n)) AS BIGINT) AS it, CAST(unnest(samples) AS DOUBLE) AS x FROM placed)
  SELECT run_id, channel, it, x FROM held WHERE x <> 0 AND NOT isnan(x) AND NOT isinf(x)""")
def read_fill_values(spark, sf):
    """Every channel of a run as one series; the samples that are no zeros, at their places."""
    series = T.placed(T.layout(_first_blocks(spark, sf), ["run_id", "channel"], "b", "fs"), ["run_id", "channel"], "_at", None)
    return series.filter((F.col("x") != 0) & ~F.isnan("x") & (F.abs("x") != float("inf")))


# every trace of 64 samples in four files of 16, as a recorder would write them
BLOCK = 16


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _traces(spark, sf).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / BLOCK).cast("int"))))
    begin = F.col("begin_us") + F.col("block") * F.lit(BLOCK * 10_000)
    samples = F.slice("samples", F.col("block") * BLOCK + 1, BLOCK)
    return rows.select("chunk", "channel", F.lit(0).cast("bigint").alias("segment_id"), F.concat_ws("/", "chunk", "block").alias("file"), begin.alias("begin_us"), (begin + (F.size(samples) - 1) * 10_000).alias("end_us"), F.lit(FS).alias("fs"), samples.alias("samples"))


@query(f"""WITH {S_SQL}, w AS (SELECT unnest([0, 1, 2]) AS k), r AS (SELECT DISTINCT chunk, channel, it // 16 AS blk FROM s),
  hit AS (SELECT chunk, channel, k, blk FROM r, w WHERE blk * 160000 < (k + 1) * 210000 AND (blk * 16 + 15) * 10000 > k * 210000)
  SELECT s.channel, CAST(k AS INT) AS place, CAST(it - min(it) OVER (PARTITION BY s.channel, k) AS INT) AS it, round(x, 6) + 0.0 AS y FROM hit JOIN s ON s.channel = hit.channel AND s.it // 16 = blk""")
def desample_windows(spark, sf):
    """Three windows of 210 ms over files of 160 ms, each read with padding and cut to its own files; without a corner, so that samples stay."""
    rows = _blocks(spark, sf)
    windows = rows.select("chunk", "segment_id").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(2))))
    windows = windows.select("chunk", "segment_id", (F.lit(BEGIN_US) + F.col("place") * 210_000).alias("window_begin"), (F.lit(BEGIN_US) + F.col("place") * 210_000 + 210_000).alias("window_end"))
    out = desampled(rows, windows, "chunk", FS, 0.0)
    place = ((F.col("window_begin") - BEGIN_US) / 210_000).cast("int")
    return out.select("channel", place.alias("place"), F.posexplode("samples").alias("it", "x")).select("channel", "place", "it", (F.round("x", 6) + 0.0).alias("y"))


@query(f"WITH {S_SQL} SELECT chunk AS event_id, channel, CAST(it - 10 AS INT) AS it, round(x, 6) + 0.0 AS y FROM s WHERE it >= 10 AND it < 50")
def event_cutouts(spark, sf):
    """One event a chunk, 300 ms after its begin, cut out of the files from 200 ms before it to 200 ms after."""
    rows = _blocks(spark, sf)
    events = rows.select("chunk").distinct().select("chunk", F.col("chunk").alias("event_id"), F.lit(BEGIN_US + 300_000).alias("event_us"))
    files = rows.select("chunk", "file", "begin_us", "end_us", "fs", F.size("samples").cast("bigint").alias("nt")).distinct()
    plan = E.extract_plan(events, files.withColumn("file", F.struct("file", "begin_us", "fs")), 200_000, 200_000, on=["chunk"])
    plan = plan.select("event_id", "file.file", "file.fs", F.col("offset").alias("first"), "n_samples", (F.col("file.begin_us") + F.col("offset") * 10_000).alias("at_us"))
    out = E.cut_samples(plan, rows)
    return out.select("event_id", "channel", F.posexplode("samples").alias("it", "x")).select("event_id", "channel", "it", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("y"))


@query("""WITH d AS (SELECT row_id, row_number() OVER (PARTITION BY file, coalesce(first_sample, 0) ORDER BY scanned_at DESC NULLS LAST, row_id DESC) AS rn FROM das_catalog) SELECT row_id FROM d WHERE rn = 1""")
def append_dedup(spark, sf):
    rows = table(spark, sf, "das_catalog").select("row_id", "file", F.coalesce("first_sample", F.lit(0)).alias("first_sample"), "scanned_at")
    return C.keep_last(rows, ["file", "first_sample"], ["scanned_at", "row_id"]).select("row_id")


@query("SELECT DISTINCT file FROM proc_headers WHERE NOT EXISTS (SELECT 1 FROM das_catalog c WHERE c.file = proc_headers.file)")
def new_files(spark, sf):
    return C.unknown_files(table(spark, sf, "proc_headers").select("file").distinct(), table(spark, sf, "das_catalog"))


@query(f"""WITH {RESOLVED}, cut AS (SELECT run_id, max(epoch_us(written_at)) AS c FROM proc_headers GROUP BY run_id)
  SELECT row_id FROM resolved LEFT JOIN cut USING (run_id) WHERE run_id IS NOT NULL AND b_us IS NOT NULL AND (c IS NULL OR b_us > c)""")
def resume_cutoff(spark, sf):
    return C.after_cutoff(_catalog(spark, sf), table(spark, sf, "proc_headers"), "run_id", F.unix_micros("written_at")).select("row_id")


@query(f"""WITH {RESOLVED}, o AS (SELECT run_id, row_id, b_us AS us, 1 / (rate / n) AS sp FROM resolved WHERE run_id IS NOT NULL AND b_us IS NOT NULL),
  d AS (SELECT *, (us - lag(us) OVER w) / 1e6 AS step, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY run_id ORDER BY us, row_id)),
  b AS (SELECT *, CASE WHEN rn = 1 OR abs(step - sp) <= 1e-8 + 1e-4 * abs(sp) THEN 0 ELSE 1 END AS br FROM d), r AS (SELECT *, sum(br) OVER (PARTITION BY run_id ORDER BY rn) AS run_no FROM b)
  SELECT run_id, CAST(run_no AS BIGINT) AS run_no, min(row_id) AS first_position, count(*) AS n_stamps, min(us) AS begin_us, max(us) AS end_us FROM r GROUP BY run_id, run_no""")
def intra_file_split(spark, sf):
    """Stretches of a run whose files begin one file length apart."""
    rows = _catalog(spark, sf).select("run_id", "row_id", F.col("begin_us").alias("us"), (F.col("rate") / F.col("n")).alias("fs"))
    return C.stamp_runs(rows, ["run_id"], "us", "fs", "row_id")


@query(f"""WITH RECURSIVE {SEG}, ends AS (SELECT run_id, segment_id, min(begin_us) AS b0, max(begin_us) AS bn FROM seg GROUP BY ALL),
  nexts AS (SELECT DISTINCT run_id, segment_id, begin_us AS b, min(begin_us) OVER (PARTITION BY run_id, segment_id ORDER BY begin_us RANGE BETWEEN 60000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb FROM seg),
  chain AS (SELECT run_id, segment_id, b0 AS b, bn FROM ends UNION ALL SELECT c.run_id, c.segment_id, x.nb, c.bn FROM chain c JOIN nexts x ON x.run_id = c.run_id AND x.segment_id = c.segment_id AND x.b = c.b WHERE x.nb IS NOT NULL)
  SELECT run_id, segment_id, b AS window_begin, b + 60000000 AS window_end FROM chain WHERE b + 60000000 <= bn""")
def window_chain(spark, sf):
    return C.window_chain(_segmented(spark, sf), "run_id", MINUTE_US)


BEFORE_US, AFTER_US = 600_000_000, 1_200_000_000


def _event_catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every event as a file of 250 samples at 1 Hz; events of type error as what is looked for."""
    rows = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    files = rows.select(F.col("event_id").alias("file"), F.col("us").alias("begin_us"), (F.col("us") + 249_000_000).alias("end_us"), F.lit(1.0).alias("fs"), F.lit(250).cast("bigint").alias("nt"))
    return rows.filter("event_type = 'error'").select("event_id", F.col("us").alias("event_us")), files


EV = """f AS (SELECT event_id AS file, epoch_us(ts) AS b, epoch_us(ts) + 249000000 AS e FROM events), q AS (SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
m AS (SELECT event_id, file, t, b, greatest(t - 600000000, b) AS lo, least(t + 1200000000, b + 250000000) AS hi FROM q JOIN f ON b < t + 1200000000 AND e > t - 600000000),
p AS (SELECT event_id, file, CAST(round_even((lo - b) / 1e6, 0) AS BIGINT) AS "offset", CAST(round_even((hi - lo) / 1e6, 0) AS BIGINT) AS n_samples, CAST(round_even((t - lo) / 1e6, 0) AS BIGINT) AS event_index FROM m)"""


@query(f"WITH {EV} SELECT * FROM p WHERE n_samples > 0")
def event_extract_plan(spark, sf):
    ev, files = _event_catalog(spark, sf)
    return E.extract_plan(ev, files, BEFORE_US, AFTER_US)


@query(f"""WITH {EV}, done AS (SELECT DISTINCT o_orderkey AS event_id FROM orders WHERE o_orderstatus = 'F'),
  st AS (SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM done d WHERE d.event_id = q.event_id) THEN 'skip' WHEN EXISTS (SELECT 1 FROM p WHERE p.event_id = q.event_id AND n_samples > 0) THEN 'extract' ELSE 'fail' END AS status FROM q)
  SELECT status, count(*) AS n FROM st GROUP BY status""")
def status_counts(spark, sf):
    ev, files = _event_catalog(spark, sf)
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return E.status_counts(E.extract_status(ev, E.extract_plan(ev, files, BEFORE_US, AFTER_US), done))


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = 'purchase' GROUP BY ALL)
  SELECT e.event_id, p.seen AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_purchases(spark, sf):
    """Every error with its user's latest purchase at or before it."""
    rows = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    errors, bought = rows.filter("event_type = 'error'").select("event_id", "user_id", "us"), rows.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("at"), F.col("event_id").alias("purchase_id"))
    return J.asof_join(errors, bought, ["user_id"], "us", "at", ["purchase_id"], 30 * C.DAY_US).select("event_id", "purchase_id")


def _located(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "das_channels").filter("run_id is not null and index_raw is not null and lat is not null and lon is not null").groupBy("run_id", "index_raw").agg(F.min_by(F.struct("lat", "lon"), "chan_id").alias("p")).select("run_id", "index_raw", "p.*")


LOC = """loc AS (SELECT run_id, index_raw, arg_min(lat, chan_id) AS lat, arg_min(lon, chan_id) AS lon FROM das_channels WHERE run_id IS NOT NULL AND index_raw IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL)"""
HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"


@query(f"""WITH {LOC}, arr AS (SELECT run_id, any_value(array_id) AS array_id FROM das_channels WHERE run_id IS NOT NULL GROUP BY run_id)
  SELECT loc.run_id, index_raw, round({HAV.format(a="loc", b="a")}, 4) AS km FROM loc JOIN arr USING (run_id) JOIN das_arrays a ON a.array_id = arr.array_id""")
def haversine(spark, sf):
    arrays = table(spark, sf, "das_arrays").select("array_id", F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    runs = table(spark, sf, "das_channels").filter("run_id is not null").groupBy("run_id").agg(F.any_value("array_id").alias("array_id"))
    rows = _located(spark, sf).join(runs, "run_id").join(arrays, "array_id")
    return rows.select("run_id", "index_raw", F.round(J.haversine_km(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon")), 4).alias("km"))


@query("SELECT CAST(5 AS BIGINT) AS ch1, vec_id AS ch2 FROM embeddings")
def shot_pairs(spark, sf):
    return J.common_shot_pairs(_traces(spark, sf), 5)


@query(f"""WITH {LOC}, d AS (SELECT a.run_id, a.index_raw AS ch1, b.index_raw AS ch2, {HAV.format(a="a", b="b")} AS km FROM loc a JOIN loc b ON a.run_id = b.run_id AND b.index_raw > a.index_raw),
  r AS (SELECT *, row_number() OVER (PARTITION BY run_id, ch1 ORDER BY round(abs(km - 0.05), 9), ch2) AS rn FROM d) SELECT run_id, ch1, ch2, round(km, 5) AS km FROM r WHERE rn = 1 AND round(abs(km - 0.05), 9) <= 0.02""")
def offset_pairs(spark, sf):
    out = J.common_offset_pairs(_located(spark, sf), "run_id", "index_raw", "lat", "lon", 0.05, 0.02)
    return out.select("run_id", "ch1", "ch2", F.round("distance_km", 5).alias("km"))


LAG = 10


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of channels that follow each other in a chunk."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("chunk").orderBy("channel")
    return _traces(spark, sf).select("chunk", F.col("channel").alias("ch1"), F.lead("channel").over(w).alias("ch2")).filter("ch2 is not null")


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    return N.pair_traces(_traces(spark, sf), _neighbours(spark, sf), "chunk")


PAIRS = f"{S_SQL}, nb AS (SELECT label AS chunk, vec_id AS ch1, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS ch2 FROM embeddings)"
LAGGED = "lags AS (SELECT CAST(unnest(range(-10, 11)) AS INT) AS lag)"


@query(f"""WITH {PAIRS}, {LAGGED} SELECT nb.ch1, nb.ch2, lag, round(coalesce(sum(a.x * b.x), 0), 4) + 0.0 AS cc FROM nb CROSS JOIN lags JOIN s a ON a.channel = nb.ch1 JOIN s b ON b.channel = nb.ch2 AND b.it = a.it + lag
  WHERE nb.ch2 IS NOT NULL GROUP BY ALL""")
def xcorr_fft(spark, sf):
    rows = _paired(spark, sf).withColumn("cc", xcorr(F.col("a"), F.col("b"), LAG))
    return N.lag_table(rows, ["ch1", "ch2"], LAG, FS).select("ch1", "ch2", "lag", (F.round("cc", 4) + 0.0).alias("cc"))


STACK = f"""{PAIRS}, {LAGGED}, part AS (SELECT *, it // 20 AS seg FROM s WHERE it < 60),
per AS (SELECT nb.chunk, nb.ch1, nb.ch2, a.seg, lag, sum(a.x * b.x) AS cc FROM nb CROSS JOIN lags JOIN part a ON a.channel = nb.ch1 JOIN part b ON b.channel = nb.ch2 AND b.it = a.it + lag AND b.seg = a.seg WHERE nb.ch2 IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {STACK} SELECT ch1, ch2, lag, round(avg(cc), 4) + 0.0 AS cc, count(*) AS nseg FROM per GROUP BY ch1, ch2, lag")
def xcorr_stack(spark, sf):
    out = N.stack(_paired(spark, sf), ["chunk"], 20, LAG)
    return N.lag_table(out, ["ch1", "ch2", "nseg"], LAG, FS).select("ch1", "ch2", "lag", (F.round("cc", 4) + 0.0).alias("cc"), "nseg")


@query(f"""WITH {STACK.replace('per AS', 'pr AS')}, st AS (SELECT chunk, ch1, ch2, lag, avg(cc) AS cc, count(*) AS nseg FROM pr GROUP BY ALL),
  rk AS (SELECT *, dense_rank() OVER (PARTITION BY chunk ORDER BY ch1) AS place FROM st) SELECT CAST(place AS INT) AS place, lag, round(sum(cc * nseg) / sum(nseg), 4) + 0.0 AS cc, CAST(sum(nseg) AS BIGINT) AS nseg FROM rk GROUP BY place, lag""")
def xcorr_dataset(spark, sf):
    """Stacks of the same place of all chunks as one, weighted by segments."""
    from pyspark.sql.window import Window

    stacks = N.stack(_paired(spark, sf), ["chunk"], 20, LAG).withColumn("place", F.dense_rank().over(Window.partitionBy("chunk").orderBy("ch1")))
    out = N.dataset_stack(stacks.select(F.col("place").alias("ch1"), F.col("place").alias("ch2"), "nseg", "cc"))
    return N.lag_table(out, ["ch1", "nseg"], LAG, FS).select(F.col("ch1").alias("place"), "lag", (F.round("cc", 4) + 0.0).alias("cc"), "nseg")


@query()
def whiten_xcorr(spark, sf):
    rows = _paired(spark, sf).withColumn("cc", xcorr(F.col("a"), F.col("b"), LAG, whitening=5.0, fs=FS, band=(2.0, 40.0)))
    return N.lag_table(rows, ["ch1", "ch2"], LAG, FS).select("ch1", "ch2", "lag", F.round("cc", 6).alias("cc"))


@query(f"""WITH {S_SQL}, n AS (SELECT *, (CASE WHEN lag(x) OVER w IS NULL THEN (lead(x) OVER w - x) / 0.01 WHEN lead(x) OVER w IS NULL THEN (x - lag(x) OVER w) / 0.01 ELSE (lead(x) OVER w - lag(x) OVER w) / 0.02 END) AS g FROM s {W_SQL}),
  f AS (SELECT channel, avg(g) AS mx, avg(it) AS mi, regr_slope(g, it) AS b FROM n GROUP BY channel), d AS (SELECT chunk, channel, it, g - (mx + b * (it - mi)) AS y FROM n JOIN f USING (channel)),
  m AS (SELECT chunk, it, median(y) AS m FROM d GROUP BY chunk, it) SELECT d.channel, d.it, CAST(sign(round(y - m, 9)) AS DOUBLE) + 0.0 AS y FROM d JOIN m ON d.chunk = m.chunk AND d.it = m.it""")
def noise_prepare(spark, sf):
    rows = N.prepare(_traces(spark, sf), ["chunk", "channel"], "chunk", DT, normalise=False)
    return _long(rows, S.one_bit(F.transform("samples", lambda v: F.round(v, 9))))


THRESHOLD = 0.25


@query(f"""WITH {S_SQL}, n AS (SELECT *, coalesce(lag(x) OVER w, '-inf'::DOUBLE) AS a, coalesce(lead(x) OVER w, '-inf'::DOUBLE) AS b FROM s {W_SQL})
  SELECT channel AS channel_index, it AS phase_index, 'P' AS phase_type, 1700000000000000 + it * 10000 AS phase_time_us, round(x, 6) AS phase_score FROM n WHERE x >= {THRESHOLD} AND x > a AND x >= b""")
def picks_threshold(spark, sf):
    rows = _traces(spark, sf)
    out = P.pick(rows, "channel", {"P": S.doubles(F.col("samples"))}, THRESHOLD, F.col("fs"), F.col("begin_us"))
    return out.withColumn("phase_score", F.round("phase_score", 6))


@query(f"""WITH {LOC}, t AS (SELECT trace_id, run_id, channel, CAST(len(samples) AS INT) AS n FROM das_traces WHERE samples IS NOT NULL AND len(samples) > 0)
  SELECT trace_id, loc.lat, loc.lon FROM t LEFT JOIN loc ON loc.run_id = t.run_id AND loc.index_raw = t.channel""")
def picks_join_coord(spark, sf):
    rows = table(spark, sf, "das_traces").filter("samples is not null and size(samples) > 0").select("trace_id", "run_id", "channel")
    return H.with_coordinates(rows, _located(spark, sf), [("run_id", "run_id"), ("channel", "index_raw")]).select("trace_id", "lat", "lon")


def _channels(spark: SparkSession, sf: str) -> DataFrame:
    """The channels without their own indices, so that these are made anew."""
    return H.normalise_channels(table(spark, sf, "das_channels").filter("run_id is not null").drop("index_taptest"), "chan_id", ["run_id"])


CH = """ch AS (SELECT chan_id, run_id, coalesce(fiber, 'u') AS fiber, CAST(coalesce(taptest, 1) AS TINYINT) AS taptest, CASE WHEN coalesce(taptest, 1) = 0 THEN 0 ELSE coalesce(quality, 1) END AS quality, lat, lon FROM das_channels WHERE run_id IS NOT NULL),
ix AS (SELECT *, CASE WHEN taptest = 1 THEN row_number() OVER (PARTITION BY run_id, fiber, taptest ORDER BY chan_id) - 1 END AS index_taptest FROM ch)"""


@query(f"WITH {CH} SELECT chan_id, fiber, taptest, CAST(quality AS TINYINT) AS quality, CAST(index_taptest AS BIGINT) AS index_taptest FROM ix")
def fiber_index(spark, sf):
    return _channels(spark, sf).select("chan_id", "fiber", "taptest", "quality", "index_taptest")


@query(f"WITH {CH} SELECT chan_id FROM ch WHERE taptest = 1 AND quality = 1")
def active_channels(spark, sf):
    return H.active(_channels(spark, sf)).select("chan_id")


@query(f"WITH {CH} SELECT chan_id FROM ch WHERE fiber = 'n'")
def channels_by_fiber(spark, sf):
    return H.by_fiber(_channels(spark, sf), "n").select("chan_id")


@query(f"WITH {CH} SELECT chan_id FROM ix WHERE taptest = 1 AND index_taptest % 5 = 0")
def channels_every_nth(spark, sf):
    return H.every_nth(_channels(spark, sf), 5).select("chan_id")


@query(f"WITH {CH} SELECT run_id, round(avg(lat), 6) AS lat0, round(avg(lon), 6) AS lon0 FROM ch WHERE taptest = 1 GROUP BY run_id")
def projection_origin(spark, sf):
    return H.origin(_channels(spark, sf), ["run_id"]).select("run_id", F.round("lat0", 6).alias("lat0"), F.round("lon0", 6).alias("lon0"))


@query(f"""WITH {CH} SELECT run_id, count(*) AS n, count(*) FILTER (taptest = 1) AS n_located, count(*) FILTER (taptest = 1 AND quality = 1) AS n_active, array_to_string(list_sort(list(DISTINCT fiber)), ',') AS fibers FROM ch GROUP BY run_id""")
def channel_summary(spark, sf):
    return H.summary(_channels(spark, sf), ["run_id"])


@query("SELECT row_id, strftime(make_timestamp(epoch_us(scanned_at)), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, epoch_us(scanned_at) AS us FROM das_catalog")
def iso_stamps(spark, sf):
    rows = table(spark, sf, "das_catalog").select("row_id", K.iso_timestamp(F.unix_micros("scanned_at")).alias("iso"))
    return rows.withColumn("us", K.parse_iso(F.col("iso")))


@query("""SELECT row_id, strftime(make_timestamp(epoch_us(scanned_at)), '%Y%m%d/') || CASE WHEN system LIKE 'Proc%' THEN system ELSE 'Proc' || system END || strftime(make_timestamp(epoch_us(scanned_at)), '-%Y-%m-%dT%H%M%SZ.h5') AS name FROM das_catalog""")
def proc_names(spark, sf):
    return table(spark, sf, "das_catalog").select("row_id", K.processed_name(F.col("system"), F.unix_micros("scanned_at"), True).alias("name"))


@query(r"""WITH p AS (SELECT row_id, regexp_extract(file, '(?:^|/)(\d{8})/(?:.*/)?\d{6}\.[^/.]+$', 1) AS d, regexp_extract(file, '/(\d{6})\.[^/.]+$', 1) AS t FROM das_catalog)
  SELECT row_id, CASE WHEN d <> '' THEN epoch_us(try_strptime(d || t, '%Y%m%d%H%M%S')) END AS us FROM p""")
def dated_names(spark, sf):
    return table(spark, sf, "das_catalog").select("row_id", K.dated_path_time(F.col("file")).alias("us"))


@query("""SELECT trace_id, round(CASE origin WHEN 'OptaSense' THEN 1e9 * coalesce(-(pi() / 32768) * 1550e-9 / (4 * pi() * 0.78 * 1.468 * gauge_length_m), 1e-9 * 1e9) WHEN 'APSensing' THEN 1e9 * 1e-9 * 100.0 ELSE 1e9 END, 6) AS nano FROM das_traces""")
def strain_factors(spark, sf):
    count = K.count_to_strain(F.lit(1550e-9), F.lit(1.468), F.col("gauge_length_m"), F.lit(7804701), F.lit("2.0"))
    factor = K.strain_factor(F.col("origin"), count, K.radian_to_strain(F.lit(100.0)))
    return table(spark, sf, "das_traces").select("trace_id", F.round(factor * 1e9, 6).alias("nano"))


@query("""WITH w AS (SELECT row_id, (1092616192 + row_id * 65537) & 4294967295 AS w FROM das_catalog)
  SELECT row_id, CAST((w >> 24) & 127 AS BIGINT) AS power, round((1 - 2 * (w >> 31)) * ((w & 16777215) / 16777216.0), 9) AS fraction FROM w""")
def ibm_words(spark, sf):
    """Words of every exponent: values as shares of 16^(power - 64)."""
    w = F.lit(1_092_616_192) + F.col("row_id") * 65537
    rows = table(spark, sf, "das_catalog").withColumn("w", w.bitwiseAND(F.lit(0xFFFFFFFF)))
    power = F.floor(F.col("w") / F.lit(1 << 24)) % 128
    return rows.select("row_id", power.cast("bigint").alias("power"), F.round(K.ibm_float(F.col("w")) / F.pow(F.lit(16.0), power - 64), 9).alias("fraction"))


@query("""SELECT hdr_id, CASE WHEN hdr_id % 5 = 0 THEN 'Proc' WHEN hdr_id % 5 = 1 THEN 'ASN' WHEN hdr_id % 5 = 2 THEN 'OptaSense' WHEN hdr_id % 5 = 3 THEN 'APSensing' ELSE 'Event' END AS kind FROM proc_headers""")
def data_kinds(spark, sf):
    roots = [["Data", "acqSpec"], ["acqSpec", "data"], ["Acquisition"], ["ProcessingServer"], ["data"]]
    groups = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in roots]), (F.col("hdr_id") % 5).cast("int") + 1)
    return table(spark, sf, "proc_headers").select("hdr_id", K.data_kind(groups, F.lit(True)).alias("kind"))


@query("SELECT trace_id, CASE WHEN system = 'Proc' THEN 'Unknown' ELSE system END AS origin FROM das_traces")
def data_origins(spark, sf):
    return table(spark, sf, "das_traces").select("trace_id", K.data_origin(F.col("system"), F.col("raw_meta")).alias("origin"))


@query(r"SELECT row_id, lower(file) LIKE '%.segy' AS segy FROM das_catalog")
def segy_names(spark, sf):
    return table(spark, sf, "das_catalog").select("row_id", K.is_segy(F.col("file")).alias("segy"))


@query(f"WITH {RESOLVED}, {PATHS} SELECT row_id, file FROM named UNION ALL SELECT row_id, NULL FROM das_catalog WHERE file IS NULL")
def file_names(spark, sf):
    """Every catalog row's file in its one spelling."""
    return table(spark, sf, "das_catalog").select("row_id", canonical_path(F.col("file")).alias("file"))
