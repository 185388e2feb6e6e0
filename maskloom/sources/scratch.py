"""Shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="maskloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    parent = _run_folder.get() or scratch_dir(spark).rstrip("/")
    return f"{parent}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """All that is settled inside lies in one folder, which is deleted at the end, whatever happens."""
    folder = new_folder(spark, "run")
    token = _run_folder.set(folder)
    try:
        yield
    finally:
        _run_folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in shared storage, its lineage cut.

    Later steps read only the columns they need and plan with the table's real size.
    """
    folder = new_folder(df.sparkSession, "settled")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


BROADCAST_BYTES = 128 << 20
# What a row takes beside its strings.
ROW_BYTES = 64


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows, else as it is.

    Beyond the limit the join shuffles, and adaptive execution splits a hot key's
    partition. ``df`` should be settled: measuring reads it once.
    """
    strings = [name for name, kind in df.dtypes if kind == "string"]
    lengths = [F.coalesce(F.octet_length(name), F.lit(0)) for name in strings]
    size = df.agg(F.sum(sum(lengths, F.lit(ROW_BYTES).cast("bigint")))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
