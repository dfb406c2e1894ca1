"""Consolidation of very many small files into fewer balanced ones.

Files are laid along a Hilbert curve over (array, time, size); exact histograms
of the codes give every file its offset along the curve, in two levels (code
prefixes, then files inside a prefix), so no task sees all files. Offsets cut
the curve into output files of a target size; a shuffle by exactly these output
files writes them, one task and one file each, and order-free digests of source
and destination rows must agree.

Defined results: rows with a null path are no file; all spellings of a path are
one file; rows of one (file, first sample) count once, with the largest count;
a file above the target is cut into pieces at the ends of output files, others
stay whole in the one they begin in; an empty table gives an empty plan. Extra
columns are ignored by the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hilbert import hilbert
from ..session import cut

BITS = 16
TOP = (1 << BITS) - 1


def place_coordinate(place: Column) -> Column:
    """16 bits of a name: ten for its first two letters, so that like names lie side by side, six of a hash that tells them apart."""
    p = F.coalesce(place, F.lit(""))
    letter = lambda i: F.ascii(F.upper(F.substring(p, i, 1))).bitwiseAND(F.lit(31))
    return (F.shiftleft(letter(1), 11) + F.shiftleft(letter(2), 6) + F.pmod(F.xxhash64(p), F.lit(64))).cast("int")


def file_chunks(df: DataFrame, row_id: str, path: Column, first: Column, count: Column, place: Column, begin_us: Column) -> DataFrame:
    """One row per distinct chunk of a file: (file, first, n, row_id, place, b), partitioned by file."""
    rows = df.select(path.alias("file"), F.coalesce(first, F.lit(0)).cast("bigint").alias("first"), count.cast("bigint").alias("n"), F.col(row_id).alias("row_id"), place_coordinate(place).alias("place"), begin_us.alias("b")).filter("file is not null")
    return rows.repartition("file").groupBy("file", "first").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min("row_id").alias("row_id"), F.min("place").alias("place"), F.min("b").alias("b"))


def file_sizes(chunks: DataFrame) -> DataFrame:
    """One row per file: (file, samples, chunks, first_row_id, place, b)."""
    return chunks.groupBy("file").agg(F.sum("n").alias("samples"), F.count("*").alias("chunks"), F.min("row_id").alias("first_row_id"), F.min("place").alias("place"), F.min("b").alias("b"))


def time_range(df: DataFrame, begin_us: Column) -> tuple[int, int]:
    """Least and greatest begin, two numbers, so that codes use every bit."""
    low, high = df.agg(F.min(begin_us), F.max(begin_us)).first()
    return low or 0, high or 0


def coded(files: DataFrame, span: tuple[int, int]) -> DataFrame:
    """``file_sizes`` with each file's code along the curve, written to the checkpoint folder, as plans read it more than once.

    Files whose begin is unknown go to the start of the range.
    """
    low, wide = span[0], max(span[1] - span[0], 1)
    when = F.floor((F.coalesce("b", F.lit(low)) - F.lit(low)) * F.lit(TOP / wide))
    size = F.floor(F.log2(F.greatest("samples", F.lit(1))) * F.lit(TOP / 64))
    return cut(files.withColumn("code", hilbert(BITS, F.col("place"), when, size)))


def compaction_plan(files: DataFrame, target: int, weight: str = "samples", prefix_bits: int = 18) -> DataFrame:
    """(file, first_row_id, samples, chunks, code, out_file, out_offset, piece_from, piece_samples) of ``coded`` files, cut by ``weight``."""
    prefixed = files.withColumn("prefix", F.shiftright("code", 3 * BITS - prefix_bits))
    # exact histogram of prefixes (at most 2**prefix_bits rows), then of the files inside each
    hist = prefixed.groupBy("prefix").agg(F.sum(weight).alias("in_prefix")).withColumn("slab", F.shiftright("prefix", prefix_bits // 2))
    slabs = hist.groupBy("slab").agg(F.sum("in_prefix").alias("in_slab"))
    slabs = slabs.select("slab", (F.sum("in_slab").over(Window.orderBy("slab")) - F.col("in_slab")).alias("slab_at"))
    inner = Window.partitionBy("slab").orderBy("prefix")
    hist = hist.withColumn("at", F.sum("in_prefix").over(inner) - F.col("in_prefix")).join(slabs, "slab").select("prefix", (F.col("at") + F.col("slab_at")).alias("prefix_at"))
    w = Window.partitionBy("prefix").orderBy("code", "file")
    placed = prefixed.withColumn("_offset", F.sum(weight).over(w) - F.col(weight)).join(hist, "prefix").withColumn("_at", F.col("_offset") + F.col("prefix_at"))
    out = lambda c: F.floor(c / F.lit(target)).cast("bigint")
    first, size = out(F.col("_at")), F.col(weight)
    placed = placed.withColumn("out_file", F.explode(F.when(size > target, F.sequence(first, out(F.col("_at") + size - 1))).otherwise(F.array(first))))
    begin = F.greatest(F.col("_at"), F.col("out_file") * target)
    held = F.when(size > target, F.least(F.col("_at") + size, (F.col("out_file") + 1) * target) - begin).otherwise(size)
    return placed.select("file", "first_row_id", "samples", "chunks", "code", "out_file", begin.alias("out_offset"), (begin - F.col("_at")).alias("piece_from"), held.alias("piece_samples"))


def row_digest(df: DataFrame, *cols: str) -> DataFrame:
    """Order-free digest of rows: (rows, digest), the sum of 60 bits of each row's MD5; equal multisets of rows have equal digests."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def write_compacted(rows: DataFrame, plan: DataFrame, path: str, key: str = "file") -> dict:
    """Writes ``rows`` (keyed by file) as the plan's output files, in the order of the curve, and compares digests.

    Rows go with their file's first piece: plan by the weight that rows have (``chunks``), or cut the rows of files above the target before.
    Raises if a row was lost or doubled on the way.
    """
    cols = rows.columns
    first = plan.filter("piece_from = 0").select(F.col("file").alias("_file"), F.col("out_file").alias("_out"), F.col("out_offset").alias("_offset"))
    n = int(first.agg(F.max("_out")).first()[0] or 0) + 1
    placed = rows.join(first, rows[key] == F.col("_file"))
    shuffled = placed.repartitionById(n, F.col("_out").cast("int")).sortWithinPartitions("_offset", *cols[:2])
    shuffled.select(*cols).write.mode("errorifexists").parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    a, b = row_digest(rows, *cols).first(), row_digest(written, *cols).first()
    if tuple(a) != tuple(b):
        raise ValueError(f"digests differ: source {tuple(a)}, destination {tuple(b)}")
    return {"files": n, "rows": a["rows"], "source": str(a["digest"]), "written": str(b["digest"])}
