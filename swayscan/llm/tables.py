"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_HELD: dict = {}


def keep_only(key=None, make=None):
    """What ``make`` returns, remembered by this process under ``key`` until another key, or none, is asked for.

    A Python worker serves one stage after another; it keeps the tables of the operator at work and no others, and
    gives the memory of those before back to the system.
    """
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)
        if key is not None:
            _HELD[key] = make()
    return _HELD.get(key)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; below a temporary folder if that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table, so that later steps do not depend on lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the workers this package once per application, for clusters that do not have it installed."""
    name = f"swayscan-{spark.sparkContext.applicationId}.zip"
    if any(name in path for path in spark.sparkContext.listFiles):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-"), name)
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
