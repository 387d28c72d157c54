"""What the operators share: tables, columns under fixed names, scratch tables, memory of a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.session import scratch_path

#: Most rows and bytes that Spark hands to Python at once; long texts then come in small batches.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its path goes to Spark's reader only."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is given at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and nothing is lost with an executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_mod(key: Column, m: int) -> Column:
    """crc32 of the key's text, modulo m; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % m


def cells(batch: pa.RecordBatch, name: str) -> list:
    """A column of an Arrow batch as Python values."""
    return batch.column(name).to_pylist()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


_HELD: dict = {}


def held(key, build: Callable):
    """``build()`` for a key that names it for the life of the application, once in each worker. Only the last one is held, so that
    a worker that goes on to another operator does not keep what the one before needed."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def once(build: Callable, *key):
    """``held`` for what is made from its key alone."""
    return held((build, key), lambda: build(*key))


def forget() -> None:
    """Drop what the worker holds."""
    _HELD.clear()


def schema_of(df: DataFrame) -> str:
    """The columns of ``df`` as the start of a schema text."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """A batch with further columns behind its own."""
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *columns.values()], [*batch.schema.names, *columns])
