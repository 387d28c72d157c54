"""Adapter: the given parquet tables seen as the article model.

``as_of`` is fixed at ``AS_OF``; some articles lie after it on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.operators.interactions import fold_interactions
from newsweave.operators.ranking import position_in_group, top_k_per_group
from newsweave.session import configure
from newsweave.sources.tables import TOPICS, Tables, spread_out

AS_OF = "2024-01-15 12:00:00"

#: Explicit schemas: no footer inference, and event time is read as an instant.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark, sf_dir, name) -> DataFrame:
    return spread_out(read(spark, sf_dir, name), SCHEMAS[name].split()[0])


def topic_of(index: Column) -> Column:
    """Topic label at ``index``, NULL past the last one."""
    return F.get(F.array(*[F.lit(t) for t in TOPICS]), index.cast("int"))


def source_number(source: Column) -> Column:
    return F.substring(source, 4, 20).cast("int")


def title_of(text: Column) -> Column:
    return F.substring(F.split_part(text, F.lit("."), F.lit(1)), 1, 255)


def sources(spark, sf_dir) -> DataFrame:
    s = F.col("source")
    return (read(spark, sf_dir, "documents").select("source").distinct()
            .select(source_number(s).alias("id"), s.alias("source_name"),
                    F.concat(F.lit("https://"), s, F.lit(".example.com/feed")).alias("feed_url")))


def content(spark, sf_dir, spread: bool = False) -> DataFrame:
    """Articles; ``spread`` deals a one-split file out to all cores for costly text work."""
    d = read(spark, sf_dir, "documents")
    d = spread_out(d, "doc_id") if spread else d
    e = read(spark, sf_dir, "events").select((F.col("event_id")).alias("join_id"), "ts")
    k = F.col("doc_id")
    return (d.join(e, F.col("join_id") == k * 5, "left")
            .select(k.alias("id"), source_number(F.col("source")).alias("source_id"),
                    title_of(F.col("text")).alias("title"), F.col("text").alias("summary"),
                    F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), k.cast("string")).alias("article_url"),
                    F.when(k % 50 != 49, F.col("ts")).alias("published_at"),
                    topic_of(k % 9).alias("topic"),
                    F.when(k % 3 != 0, F.concat(F.lit("https://cdn.example.com/"), k.cast("string"), F.lit(".jpg"))).alias("image_url")))


def interaction_log(spark, sf_dir) -> DataFrame:
    """Append-only read/like commands; a NULL flag means the command did not touch it."""
    n = read(spark, sf_dir, "documents").select(F.count("*").alias("n")).scalar()
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("event_id") % n).alias("content_id"),
        F.when(kind.isin("view", "click"), F.lit(True)).when(kind == "error", F.lit(False)).alias("is_read"),
        F.when(kind == "purchase", F.lit(True)).when(kind == "signup", F.lit(False)).alias("is_liked"),
        F.col("ts").alias("interaction_at"))


def interactions(spark, sf_dir) -> DataFrame:
    return fold_interactions(None, interaction_log(spark, sf_dir))


def users(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id").distinct()


def user_topics(spark, sf_dir) -> DataFrame:
    """Two interests per user (one when both rules agree); every tenth user has none."""
    u = F.col("user_id")
    return (users(spark, sf_dir).where(u % 10 != 0)
            .select("user_id", F.explode(F.array_distinct(F.array(topic_of(u % 8), topic_of((u * 3 + 1) % 8)))).alias("topic")))


def tables(spark, sf_dir, spread: bool = False) -> Tables:
    return Tables(sources(spark, sf_dir), content(spark, sf_dir, spread), interactions(spark, sf_dir),
                  user_topics(spark, sf_dir), users(spark, sf_dir))


def _link() -> Column:
    k = F.col("doc_id")
    return F.concat(F.lit("https://news.example.com/a/"), F.when(k % 5 == 0, k + 1).otherwise(k).cast("string"))


def feed_links(spark, sf_dir) -> DataFrame:
    """Entries without their place in the feed; links are shared across feeds."""
    return read(spark, sf_dir, "documents").select(
        source_number(F.col("source")).alias("source_id"), F.col("source").alias("source_name"), _link().alias("link"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("summary"), topic_of(F.col("doc_id") % 9).alias("topic"), "doc_id")


def feed_items(spark, sf_dir, cap: int | None = None) -> DataFrame:
    """Entries as feeds deliver them, newest document first: ``pos`` is the 0-based place. With
    ``cap`` only the first entries of each feed are placed."""
    keys = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_k"), "source")
    order = [F.col("_k").desc()]
    placed = top_k_per_group(keys, ["source"], order, cap, "_n") if cap else position_in_group(keys, ["source"], order, "_n")
    return (feed_links(spark, sf_dir).join(placed.select("_k", (F.col("_n") - 1).alias("pos")), F.col("doc_id") == F.col("_k"))
            .drop("_k"))


def url_status(spark, sf_dir) -> DataFrame:
    """Crawl status per link."""
    return (read(spark, sf_dir, "documents").select(_link().alias("url"), F.when(F.col("doc_id") % 11 == 0, 404).otherwise(200).alias("status"))
            .groupBy("url").agg(F.max("status").alias("status")))


def stored_urls(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(_link().alias("article_url")).distinct()
