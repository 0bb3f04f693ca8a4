"""Session helpers shared by every operator: table access, scratch tables and shipping of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Spark's own switch; without it shuffle files stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; a plain file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where the driver found it by sys.path alone."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest_pkg.zip")
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds, so that a batch of very long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables; a local one only where the cluster names none."""
    context = spark.sparkContext._jsc.sc()
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and context.getCheckpointDir().isDefined():
        found = context.getCheckpointDir().get()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-scratch-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Actions planned inside remove their shuffle files as soon as they have run."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors cost no recomputation and no shuffle files are left."""
    path = scratch_path(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
