"""Intermediate tables in the shared scratch folder: lineage is cut, plans stay small, and lost executors cost no
recomputation."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset (tests, one machine) a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        else:
            root = tempfile.mkdtemp(prefix="matchloom-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/matchloom/{uuid.uuid4().hex}"


def held(frame: DataFrame) -> DataFrame:
    """The frame, written as Parquet and read back."""
    path = folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def give_back() -> None:
    """Hands unused memory of a worker process, which outlives its tasks, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries
        pass
