"""Reader state: read/like commands folded into one row per (user, article)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = ["user_id", "content_id", "is_read", "is_liked", "interaction_at"]
LOG = ["user_id", "content_id", "is_read", "is_liked", "interaction_at", "event_id"]


def fold_interactions(state: DataFrame | None, log: DataFrame) -> DataFrame:
    """New state after ``log``: the last command that sets a flag wins, untouched flags keep
    their value, never-set flags are false, and a command that sets nothing is dropped.

    Commands are ordered by (time, event_id); the old state comes before all of them. One
    aggregate by key with map-side combine, so a busy reader or article is not a hot task.
    """
    commands = log.select(*LOG).where(F.col("is_read").isNotNull() | F.col("is_liked").isNotNull())
    order = ["interaction_at", "event_id"]
    if state is not None:
        before = state.select(*STATE, F.lit(0).cast("long").alias("event_id"), F.lit(0).alias("_phase"))
        commands = before.unionByName(commands.withColumn("_phase", F.lit(1)))
        order = ["_phase", *order]
    turn = F.struct(*order)

    def last_set(flag):
        seen = F.max_by(flag, F.when(F.col(flag).isNotNull(), turn))
        return F.coalesce(seen, F.lit(False)).alias(flag)

    return commands.groupBy("user_id", "content_id").agg(
        last_set("is_read"), last_set("is_liked"),
        F.max("interaction_at").alias("interaction_at"))


def mark_read(log: DataFrame, is_read: bool = True) -> DataFrame:
    """(user_id, content_id, interaction_at, event_id) rows as read/unread commands."""
    return log.select("user_id", "content_id", F.lit(is_read).alias("is_read"),
                      F.lit(None).cast("boolean").alias("is_liked"), "interaction_at", "event_id")


def toggle_like(log: DataFrame, is_liked: bool = True) -> DataFrame:
    """(user_id, content_id, interaction_at, event_id) rows as like/unlike commands."""
    return log.select("user_id", "content_id", F.lit(None).cast("boolean").alias("is_read"),
                      F.lit(is_liked).alias("is_liked"), "interaction_at", "event_id")


def per_article(interactions: DataFrame) -> DataFrame:
    """Counts by article, taken before any join so the join never fans out."""
    return interactions.groupBy(F.col("content_id").alias("_cid")).agg(
        F.count("*").alias("_touches"), F.count_if("is_read").alias("_reads"))


def liked_ids(interactions: DataFrame) -> DataFrame:
    return interactions.where("is_liked").select("content_id").distinct()
