"""Reader state as a table in buckets of (user, article).

The state is larger than any batch of commands and any page of articles that it meets, so it is stored the way it is joined: hashed
into buckets by both keys, sorted in each. A fold moves the commands only and merges them bucket by bucket; a left or anti join
moves the page only. Both keys make the buckets, so a reader with a third of all rows fills no bucket of its own.
Every fold writes a new version; the one before can be dropped when nobody reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.operators.interactions import STATE
from newsweave.session import scratch_path

KEYS = ["user_id", "content_id"]


def write_state(state: DataFrame, buckets: int | None = None, path: str | None = None) -> str:
    """Store ``state`` in buckets (as many as shuffle partitions unless given) and return the table's name."""
    spark = state.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"reader_state_{uuid.uuid4().hex}"
    # dealt out as the buckets are, so each is one file
    (state.select(*STATE).repartition(buckets, *KEYS).sortWithinPartitions(*KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS)
     .option("path", path or scratch_path(spark, "state")).saveAsTable(name))
    return name


def read_state(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).select(*STATE)


def drop_state(spark: SparkSession, name: str) -> None:
    """Forget a version; its files stay where they were written."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def last_settings(log: DataFrame) -> DataFrame:
    """Per (user, article) what a batch of commands sets last: ``_read`` and ``_liked`` (NULL: untouched) and the latest time."""
    commands = log.where(F.col("is_read").isNotNull() | F.col("is_liked").isNotNull())
    turn = F.struct("interaction_at", "event_id")
    last = lambda flag: F.max_by(flag, F.when(F.col(flag).isNotNull(), turn))
    return commands.groupBy(*KEYS).agg(last("is_read").alias("_read"), last("is_liked").alias("_liked"), F.max("interaction_at").alias("_at"))


def folded(state: DataFrame, log: DataFrame, buckets: int | None = None) -> DataFrame:
    """The state after ``log``; equal to ``fold_interactions(state, log)``. The commands are dealt out as the ``buckets`` of the state are, which
    stays where it is. Tables with fewer buckets than shuffle partitions need the number, as the planner prefers more partitions."""
    new = last_settings(log if buckets is None else log.repartition(buckets, *KEYS))
    return (state.join(new, KEYS, "full_outer").select(
        *KEYS, F.coalesce("_read", "is_read", F.lit(False)).alias("is_read"), F.coalesce("_liked", "is_liked", F.lit(False)).alias("is_liked"),
        F.greatest("interaction_at", "_at").alias("interaction_at")))


def fold_into(spark: SparkSession, name: str, log: DataFrame, path: str | None = None) -> str:
    """Merge ``log`` into the buckets of table ``name``; returns the name of the new version."""
    buckets = buckets_of(spark, name)
    return write_state(folded(read_state(spark, name), log, buckets), buckets, path)


def buckets_of(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])
