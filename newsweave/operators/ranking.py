"""Ranking without a hot task.

``row_number() <= k`` is planned by Spark with a group limit below the shuffle, so a
group that holds a third of all rows sends at most k rows per map task. For larger k those
rows meet in slices first; and exact positions of *every* row, which would put a whole group
in one task, come from a distributed sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.session import HEAD_LIMIT, cut_lineage

#: Up to here the rows of all map tasks may meet in one task.
GROUP_LIMIT = 1000


def top_k_per_group(df: DataFrame, group: list, order: list[Column], k: int, rank: str = "rank", spread: int = 64) -> DataFrame:
    """First ``k`` rows of every group with their 1-based ``rank``; ``order`` must end in a unique key.

    Every map task sends at most k rows per group. For k above ``GROUP_LIMIT`` the tasks are
    gathered in ``spread`` slices that are cut to k each before the last cut.
    """
    if k > GROUP_LIMIT:
        first = Window.partitionBy(*group, "_slice").orderBy(*order)
        df = (df.withColumn("_slice", F.spark_partition_id() % spread).withColumn("_cut", F.row_number().over(first))
              .where(F.col("_cut") <= k).drop("_cut", "_slice"))
    final = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def first_per_group(df: DataFrame, group: list, order: list[Column]) -> DataFrame:
    return top_k_per_group(df, group, order, 1, "_first").drop("_first")


def position_in_group(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Exact 1-based position of **every** row in its group, whatever the group size.

    One range-partitioned sort by (group, order); each row is numbered inside its sorted
    partition, and the start of every (group, partition) run is added. The run table has
    at most groups + partitions rows. The sort is written to the shared checkpoint folder
    because both uses of it must see the same partition bounds.
    """
    ordered = cut_lineage(df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    runs = (ordered.groupBy(*group, part.alias("_part"))
            .agg(F.min("_at").alias("_from"), F.count("*").alias("_n")))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part"), "_from",
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_p") == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (ordered.withColumn("_p", part).join(starts, same)
            .select(*df.columns, (F.col("_at") - F.col("_from") + F.col("_before") + 1).cast("long").alias(rank)))


def ranked_head(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` per group for any k: window path up to ``HEAD_LIMIT``, distributed sort beyond."""
    if k <= HEAD_LIMIT:
        return top_k_per_group(df, group, order, k, rank)
    return position_in_group(df, group, order, rank).where(F.col(rank) <= k)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``ORDER BY .. LIMIT .. OFFSET``; stays a per-partition top-(limit + offset)."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def shuffle_page(df: DataFrame, key: Column, seed: int, offset: int = 0, refresh: bool = False) -> DataFrame:
    """Mix the rows of one page, for the first page or on refresh. The order is a hash of
    (key, seed), so the same seed repeats it."""
    if offset == 0 or refresh:
        return df.orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df
