"""Mergeable hourly counts by article, from which every trend window is added up.

A row says by how much the counts of an article changed in an hour: ``articles`` (1 when it came), ``touches`` (new reader states) and
``reads`` (states that became read, less those that became unread). Rows of any number of batches add up to the counts of the state
after them, so a batch of reader commands costs its own keys only, and neither the state nor the log is counted again.
The table is partitioned by the day of publication, which is what the windows ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.operators import articles as A

KEYS = ["published_on", "id", "topic", "published_at"]
COUNTS = ["articles", "touches", "reads"]
PARTIAL = [*KEYS, "hour", *COUNTS]
SCHEMA = "id long, topic string, published_at timestamp, hour timestamp, articles long, touches long, reads long, published_on date, batch int"


def article_rows(content: DataFrame) -> DataFrame:
    """Rows of newly stored articles. Undated ones are in no window and get none."""
    dated = content.where(F.col("published_at").isNotNull())
    return dated.select(F.to_date("published_at").alias("published_on"), "id", "topic", "published_at", F.date_trunc("hour", "published_at").alias("hour"),
                        F.lit(1).cast("long").alias("articles"), F.lit(0).cast("long").alias("touches"), F.lit(0).cast("long").alias("reads"))


def state_rows(after: DataFrame, content: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Rows of a batch: ``after`` holds the new state of the (user, article) pairs it touched, ``before`` what they had (None: nothing)."""
    new = after.select("user_id", "content_id", F.date_trunc("hour", "interaction_at").alias("hour"), F.col("is_read").cast("long").alias("_new"))
    if before is None:
        changed = new.withColumns({"_touch": F.lit(1).cast("long"), "_read": F.col("_new")})
    else:
        old = before.select("user_id", "content_id", F.col("is_read").cast("long").alias("_old"))
        changed = new.join(old, ["user_id", "content_id"], "left").withColumns(
            {"_touch": F.when(F.col("_old").isNull(), 1).otherwise(0).cast("long"), "_read": F.col("_new") - F.coalesce("_old", F.lit(0))})
    by_article = changed.groupBy("content_id", "hour").agg(F.sum("_touch").alias("touches"), F.sum("_read").alias("reads")).where("touches <> 0 or reads <> 0")
    dated = content.where(F.col("published_at").isNotNull()).select("id", "topic", "published_at")
    return by_article.join(dated, F.col("content_id") == F.col("id")).select(
        F.to_date("published_at").alias("published_on"), "id", "topic", "published_at", "hour", F.lit(0).cast("long").alias("articles"), "touches", "reads")


def merged(rows: DataFrame) -> DataFrame:
    """Rows of all batches with one row for each article and hour; merging merged rows again changes nothing."""
    return rows.groupBy(*KEYS, "hour").agg(*[F.sum(c).alias(c) for c in COUNTS]).select(*PARTIAL)


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Store one batch; written again it replaces itself."""
    (merged(rows).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("published_on", "batch").parquet(path))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def by_article(rows: DataFrame, since=None) -> DataFrame:
    """(id, topic, published_at, interaction_count, view_count) of the articles published ``since``; only their partitions are read."""
    if since is not None:
        rows = rows.where((F.col("published_on") >= F.to_date(since)) & (F.col("published_at") >= since))
    return rows.groupBy("id", "topic", "published_at").agg(F.sum("touches").alias("interaction_count"), F.sum("reads").alias("view_count"))


def daily_trends(rows: DataFrame, since=None) -> DataFrame:
    """(date, topic, article_count, view_count, interaction_count) added up from the partial rows, of the days ``since``."""
    dated = rows.where(A.has_topic())
    if since is not None:
        dated = dated.where(F.col("published_on") >= since)
    return dated.groupBy(F.col("published_on").alias("date"), "topic").agg(
        F.sum("articles").alias("article_count"), F.sum("reads").alias("view_count"), F.sum("touches").alias("interaction_count"))
