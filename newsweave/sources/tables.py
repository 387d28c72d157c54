"""Table bundle handed to every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The eight topic labels, in display order.
TOPICS = (
    "AI & ML",
    "Cybersecurity & Privacy",
    "Cloud Computing & DevOps",
    "Software Development & Web Technologies",
    "Emerging Technologies",
    "Big Tech & Industry Trends",
    "Tech Culture & Work",
    "Open Source",
)


@dataclass(frozen=True)
class Tables:
    """The model tables as lazy DataFrames. Nothing is read until an operator needs it."""

    sources: DataFrame
    content: DataFrame
    interactions: DataFrame
    user_topics: DataFrame
    users: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.content.sparkSession

    def with_(self, **changes) -> "Tables":
        return replace(self, **changes)

    @staticmethod
    def from_parquet(spark: SparkSession, root: str) -> "Tables":
        """Open a warehouse folder that holds one parquet table per name."""
        read = lambda name: spark.read.parquet(f"{root.rstrip('/')}/{name}")
        return Tables(read("sources"), read("content"), read("user_content_interactions"), read("user_topics"))

    @staticmethod
    def from_catalog(spark: SparkSession, database: str) -> "Tables":
        read = lambda name: spark.table(f"{database}.{name}")
        return Tables(read("sources"), read("content"), read("user_content_interactions"), read("user_topics"))

    @staticmethod
    def from_jdbc(spark: SparkSession, url: str, options: dict | None = None, partitions: int = 64,
                  bounds: dict[str, tuple[str, int, int]] | None = None) -> "Tables":
        """Open a live database. ``bounds`` names (column, lower, upper) per table so the
        scan is split into ``partitions`` range reads; filters are pushed to the database."""
        def read(name):
            reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**(options or {}))
            if bounds and name in bounds:
                column, low, high = bounds[name]
                reader = (reader.option("partitionColumn", column).option("lowerBound", low)
                          .option("upperBound", high).option("numPartitions", partitions))
            return reader.load()

        return Tables(read("sources"), read("content"), read("user_content_interactions"), read("user_topics"))


def user_topics(t: Tables, user_id: int | None = None) -> DataFrame:
    """(user_id, topic): interests, of one reader or of all, each once."""
    return one_user(t.user_topics, user_id).select("user_id", "topic").distinct()


def topic_dimension(spark: SparkSession) -> DataFrame:
    """(k, topic): eight fixed rows."""
    return spark.createDataFrame(list(enumerate(TOPICS)), "k int, topic string")


def distinct_users(tables: Tables) -> DataFrame:
    """Every known user id: the users table where there is one, else ids seen in state and interests."""
    if tables.users is not None:
        return tables.users.select("user_id").distinct()
    return (tables.interactions.select("user_id").distinct()
            .unionByName(tables.user_topics.select("user_id").distinct()).distinct())


def one_user(df: DataFrame, user_id: int | None) -> DataFrame:
    """Restrict to one user; ``None`` keeps everybody."""
    return df if user_id is None else df.where(F.col("user_id") == F.lit(user_id))


def spread_out(df: DataFrame, key: str) -> DataFrame:
    """Deal out a scan that has fewer splits than the session has cores, before costly per-row
    work. A scan with enough splits - every large table - is left as it is: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
