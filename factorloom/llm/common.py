"""What the training-data operators share: reading, shared storage and small numeric helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark only, so any path that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none, as in tests, a temporary folder is set once per session. On a
    cluster that would be a folder of one machine, so there the setting must be made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='factorloom-')}")
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/factorloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, so what follows never recomputes what came before. The shuffle
    files behind them are of no more use and are removed as soon as the table is written.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Rows of ``groups`` groups dealt by key for work that is heavy though its rows are light.

    Partitions of light rows would be coalesced by their bytes, and the groups done one after another.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(groups, parts)), *keys)


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays alive between tasks, and its heap with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # where the C library has it
        trim(0)


def row_groups(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows whose lengths add up to about ``most``; a longer row is alone."""
    if not len(lengths):
        return []
    part = (np.cumsum(lengths) - lengths) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(lengths)]
    return list(zip(edges[:-1], edges[1:], strict=True))
