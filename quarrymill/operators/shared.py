"""Tables that a plan reads more than once, cut to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_local: dict[str, str] = {}
_shipped: set[str] = set()


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, as in tests. A cluster must name its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return _local[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: what follows runs it once, and its lineage ends in files that outlive any executor."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once an application, for tasks that run its Python."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quarrymill-"), "quarrymill.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(PACKAGE.rglob("*.py")):
            out.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
