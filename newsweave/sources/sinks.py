"""Writers: JSON documents and partition-wise table replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave.functions.text import iso_timestamp


def as_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON document per row; timestamps as ISO text, NULLs kept."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    values = [iso_timestamp(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in fields]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, written by all tasks; the folder is the result."""
    df.select(as_json(df).alias("value")).write.mode(mode).text(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace exactly the partitions ``df`` holds. The rebalance step gathers each partition into few
    files and splits a partition that is too large for one task, whatever its share of the rows."""
    (df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
