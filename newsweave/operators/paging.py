"""Pages at any depth: keys in range partitions with counts, and seek keys.

The keys of a table are written once in the order of the pages, in at most ``MAX_PARTS`` partitions of about ``PAGE_ROWS`` rows, larger ones beyond, beside the number of rows of
each. A page at an offset is looked up in the counts (one number for each partition) and read from the partitions it lies in, so its
cost does not depend on the offset and no task sorts more than a few partitions. Who has the last row of a page continues by its key instead
(``after``), without any index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.operators.articles import newest_first
from newsweave.operators.ranking import page
from newsweave.session import scratch_path

PAGE_ROWS = 100_000
#: Most partitions of an index, whatever a table holds: their bounds, counts and files are all that the driver hears of.
MAX_PARTS = 1000


@dataclass(frozen=True)
class PageIndex:
    """Written keys (id, published_at, part) and the rows of each part, in order."""

    spark: SparkSession
    path: str
    schema: str
    rows: tuple[int, ...]

    def parts_of(self, limit: int, offset: int) -> tuple[list[int], int]:
        """The partitions in which a page lies, and the rows of the first of them before it."""
        found, before, start = [], 0, 0
        for part, n in enumerate(self.rows):
            if start < offset + limit and start + n > offset:
                if not found:
                    before = offset - start
                found.append(part)
            start += n
        return found, max(before, 0)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Keys of the page, newest first."""
        parts, before = self.parts_of(limit, offset)
        table = self.spark.read.schema(self.schema).parquet(self.path)
        return page(table.where(F.col("part").isin(parts) if parts else F.lit(False)).drop("part"), newest_first(), limit, before)


def page_index(articles: DataFrame, page_rows: int = PAGE_ROWS, path: str | None = None) -> PageIndex:
    """Index over (id, published_at, and further narrow columns) of ``articles``, in partitions of ``page_rows`` rows or, if those were more than
    ``MAX_PARTS``, in that many."""
    spark = articles.sparkSession
    path = path or scratch_path(spark, "pages")
    parts = min(MAX_PARTS, max(1, -(-articles.count() // page_rows)))
    # as many parts as asked for, also where few keys are sampled
    dealt = articles.repartitionByRange(parts, *newest_first()).withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("part", *newest_first()).write.partitionBy("part").parquet(path)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in articles.schema) + "part int"
    counts = {r["part"]: r["count"] for r in spark.read.schema(schema).parquet(path).groupBy("part").count().collect()}
    return PageIndex(spark, path, schema, tuple(counts.get(i, 0) for i in range(parts)))


def after(published_at, article_id: int) -> Column:
    """Rows behind the one with this key, newest first: the seek condition of the next page. An undated row (None) is followed
    by undated ones with a larger id and by all dated ones."""
    at, key = F.col("published_at"), F.col("id")
    if published_at is None:
        return at.isNotNull() | (key > article_id)
    moment = F.lit(published_at).cast("timestamp")
    return (at < moment) | ((at == moment) & (key > article_id))


def seek_page(articles: DataFrame, limit: int, last: tuple | None = None) -> DataFrame:
    """The next ``limit`` rows behind ``last`` (published_at, id): each task keeps ``limit`` rows, however deep the page lies."""
    return page(articles if last is None else articles.where(after(*last)), newest_first(), limit)
