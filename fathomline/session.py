"""Session helpers: code on the executors, table access, checkpoint folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once per Spark context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_fathomline_shipped", False):
        return
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="fathomline-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the file from there as long as this runs
    path = Path(folder) / "fathomline.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._fathomline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` names the folder that all executors share; a local
    temporary folder is only used where the setting is missing and the master
    is this very machine.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fathomline-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so later jobs don't recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
