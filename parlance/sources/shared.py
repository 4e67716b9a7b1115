"""Tables kept in the folder that all executors share, `spark.checkpoint.dir`."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path below `spark.checkpoint.dir`.

    Where none is named, a session with a local master, as in tests, uses its warehouse; any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/parlance/{name}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: they go when the write ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
