"""Deletes from partitioned tables that rewrite only the partitions with rows to delete.

The keys to delete are joined to the table's key columns, which tells the partitions that hold any; only these are read whole,
written to the shared folder without the rows, and put in place of the old ones. The files of all other partitions stay as they are. A
delete that finds nothing writes nothing, so running it again is free. A partition that loses all rows is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.session import scratch_path
from newsweave.sources.sinks import replace_partitions


def touched_partitions(table: DataFrame, gone: DataFrame, keys: list[str], by: list[str]) -> list[tuple]:
    """Partitions of ``table`` that hold a row with a key of ``gone``: at most as many as the table has."""
    found = table.select(*dict.fromkeys([*by, *keys])).join(gone.select(*keys), keys, "left_semi").select(*by).distinct()
    return [tuple(r) for r in found.collect()]


def in_partitions(by: list[str], parts: list[tuple]) -> Column:
    """Rows of these partitions, as a condition that prunes the scan."""
    inside = F.lit(False)
    for p in parts:
        here = F.lit(True)
        for c, v in zip(by, p):
            here = here & (F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
        inside = inside | here
    return inside


def delete_rows(spark: SparkSession, path: str, schema, gone: DataFrame, keys: list[str], by: list[str]) -> list[tuple]:
    """Delete the rows of the table at ``path`` (partitioned ``by`` columns) whose ``keys`` are in ``gone``; returns the partitions rewritten."""
    table = spark.read.schema(schema).parquet(path)
    parts = touched_partitions(table, gone, keys, by)
    if not parts:
        return []
    scratch = scratch_path(spark, "rewrite")
    table.where(in_partitions(by, parts)).join(gone.select(*keys).distinct(), keys, "left_anti").select(*table.columns).write.parquet(scratch)
    kept = spark.read.schema(table.schema).parquet(scratch)
    left = {tuple(r) for r in kept.select(*by).distinct().collect()}
    if left:
        replace_partitions(kept, path, by)
    for p in parts:
        if p not in left:
            remove_partition(spark, path, by, p)
    return parts


def remove_partition(spark: SparkSession, path: str, by: list[str], part: tuple) -> None:
    """Remove the folder of one partition."""
    names = [f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(by, part)]
    folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *names]))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
