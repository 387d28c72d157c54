"""Table schemas and their constraints, as Spark types."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_s, _l, _b, _ts, _d = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType(), T.DateType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


CLASSIFICATION = _struct(
    ("method", _s, True), ("ai_used", _b, True), ("confidence", T.DoubleType(), True), ("reason", _s, True)
)

SCORES = T.ArrayType(_struct(("label", _s, True), ("score", T.DoubleType(), True)))

FEED_ENTRY = _struct(
    ("link", _s, True),
    ("title", _s, True),
    ("summary", _s, True),
    ("published", _ts, True),
    ("content", T.ArrayType(_struct(("value", _s, True))), True),
    ("media_content", T.ArrayType(_struct(("url", _s, True))), True),
    ("media_thumbnail", T.ArrayType(_struct(("url", _s, True))), True),
    ("enclosures", T.ArrayType(_struct(("href", _s, True))), True),
    ("image", _struct(("href", _s, True)), True),
)

#: name -> (schema, partition columns, key columns)
TABLES: dict[str, tuple[T.StructType, list[str], list[str]]] = {
    "sources": (
        _struct(("id", _l, False), ("source_name", _s, False), ("feed_url", _s, False),
                ("last_fetched_at", _ts, True), ("created_at", _ts, True), ("updated_at", _ts, True)),
        [], ["id"],
    ),
    "content": (
        _struct(("id", _l, False), ("source_id", _l, False), ("title", _s, False), ("summary", _s, True),
                ("article_url", _s, False), ("published_at", _ts, True), ("topic", _s, True),
                ("image_url", _s, True), ("classification_method", _s, True),
                ("ai_confidence_score", T.DecimalType(4, 3), True),
                ("classification_metadata", CLASSIFICATION, True), ("published_on", _d, True)),
        ["published_on"], ["id"],
    ),
    "user_preferences": (
        _struct(("user_id", _l, False), ("summary_type", _s, True), ("summary_length", _s, True),
                ("updated_at", _ts, True)),
        [], ["user_id"],
    ),
    "user_content_interactions": (
        _struct(("user_id", _l, False), ("content_id", _l, False), ("is_read", _b, False),
                ("is_liked", _b, False), ("interaction_at", _ts, True)),
        [], ["user_id", "content_id"],
    ),
    "user_topics": (_struct(("user_id", _l, False), ("topic", _s, False)), [], ["user_id", "topic"]),
    "topic_trends": (
        _struct(("topic", _s, False), ("article_count", _l, False), ("view_count", _l, False),
                ("interaction_count", _l, False), ("date", _d, False)),
        ["date"], ["date", "topic"],
    ),
    "daily_digests": (
        _struct(("user_id", _l, False), ("summary", _s, True), ("article_ids", T.ArrayType(_l), True),
                ("sent_at", _ts, True), ("opened_at", _ts, True), ("date", _d, False)),
        ["date"], ["user_id", "date"],
    ),
    "run_log": (
        _struct(("run_at", _ts, False), ("success", _b, False), ("articles_added", _l, True), ("error", _s, True)),
        [], ["run_at"],
    ),
    "expiring_codes": (
        _struct(("id", _l, False), ("user_id", _l, False), ("code", _s, False), ("expires_at", _ts, False),
                ("used", _b, False), ("created_at", _ts, True)),
        [], ["id"],
    ),
}

#: Longest accepted value per column; longer rows are refused, not cut.
MAX_LENGTHS = {"source_name": 100, "feed_url": 255, "title": 255, "article_url": 255, "topic": 100}


def create_tables(spark: SparkSession, database: str, names: list[str] | None = None, fmt: str = "parquet") -> list[str]:
    """``CREATE TABLE IF NOT EXISTS`` for every model table; returns the qualified names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    created = []
    for name in names or list(TABLES):
        schema, partitions, _ = TABLES[name]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING {fmt}{by}")
        created.append(f"{database}.{name}")
    return created
