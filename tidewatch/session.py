"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each session's context."""
    context = spark.sparkContext
    if getattr(context, "_tidewatch_package", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver's own: Spark serves the archive from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/tidewatch-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(archive)
    context._tidewatch_package = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, one of our own, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder: what comes next does not plan or compute again what made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
