"""Helpers of the operators: tables kept in the cluster's shared folder, size-checked broadcasts, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that contracts call white space: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: A side of at most so many bytes (rows times row width, counted) is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share, `spark.checkpoint.dir`.

    Where none is named, a session with a local master, as in tests, uses its warehouse; any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/parlance-llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A kept table with a broadcast hint if its counted size is within the limit, else as it is (for a shuffle join)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def words_count(text: str = "text"):
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def in_one(df: DataFrame, **columns: str) -> DataFrame:
    """df with each row packed into one struct, `__row`, beside copies of the named columns: so none can clash."""
    return df.select(F.struct([F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def append_columns(
    df: DataFrame, fields: list[T.StructField], make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], drop: Sequence[str] = ()
) -> DataFrame:
    """df with new columns (replacing those of the same names, in any case); `make` turns batches into (batch, arrays).

    Columns to `drop` are read by `make` and don't come back from it.
    """
    names = {f.name.lower() for f in fields} | {c.lower() for c in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    out_names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in make(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + arrays, names=out_names)
        give_back()

    return df.mapInArrow(run, T.StructType(kept + fields))


def give_back() -> None:
    """Return what a task has freed to the system: Python workers stay between tasks, and so would their memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches that reach about `most` bytes; larger batches are cut, whole rows only."""
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, most):
            held.append(batch)
            size += batch.nbytes
            if size >= 0.75 * most:
                yield held
                held, size = [], 0
    if held:
        yield held


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `most` bytes, by its mean row."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
