"""A Bloom filter over stored URLs, as a table kept beside them.

The filter has blocks of 32,768 bits (4 KB). A URL's hash names its block and ``HASHES`` bits in it, so a test meets one
block. Blocks are built, and extended by inserts, with Spark's bitmap aggregates: both are merges by block with map-side combine, and
the order of inserts does not matter. A filter made for n URLs has ``BITS`` bits for each: n x 2 bytes in all. Up to ``BROADCAST_BLOCKS`` blocks
(16 MB) it is sent to the tasks; a larger one is joined by block with narrow rows.

Rows whose bits are not all set are certainly not stored; only the others meet the stored table in an exact join. A filter that was made for fewer
URLs than it holds lets more rows through and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS, BITS, HASHES, BROADCAST_BLOCKS = 32_768, 16, 7, 4096


def blocks_for(urls: int) -> int:
    return max(1, -(-urls * BITS // BLOCK_BITS))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("long")


def _places(url: Column) -> list[Column]:
    """Bits of a URL in its block, from two further hashes."""
    a, b = (F.pmod(F.xxhash64(url, F.lit(salt)), F.lit(BLOCK_BITS)) for salt in ("a", "b"))
    return [F.pmod(a + F.lit(i) * (b * 2 + 1), F.lit(BLOCK_BITS)) for i in range(HASHES)]


def build(urls: DataFrame, blocks: int, url: str = "article_url") -> DataFrame:
    """(block, blocks, bits) of a filter over ``urls``; at most ``blocks`` rows of 4 KB."""
    at = urls.where(F.col(url).isNotNull()).select(_block(F.col(url), blocks).alias("block"), F.explode(F.array(*_places(F.col(url)))).alias("_at"))
    return at.groupBy("block").agg(F.bitmap_construct_agg("_at").alias("bits")).select("block", F.lit(blocks).alias("blocks"), "bits")


def extended(known: DataFrame, urls: DataFrame, blocks: int, url: str = "article_url") -> DataFrame:
    """The filter with further URLs; ``blocks`` as when it was made."""
    return known.unionByName(build(urls, blocks, url)).groupBy("block", "blocks").agg(F.bitmap_or_agg("bits").alias("bits"))


def _set(bits: Column, place: Column) -> Column:
    """Whether a bit of a block is set: bit 0 is the lowest of the first byte."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def marked(entries: DataFrame, known: DataFrame, blocks: int, url: str = "link", mark: str = "_maybe") -> DataFrame:
    """``entries`` with a mark: false for URLs that are certainly not in the filter."""
    side = known.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    side = F.broadcast(side) if blocks <= BROADCAST_BLOCKS else side
    test = F.lit(True)
    for place in _places(F.col(url)):
        test = test & _set(F.col("_bits"), place)
    joined = entries.withColumn("_b", _block(F.coalesce(F.col(url), F.lit("")), blocks)).join(side, F.col("_b") == F.col("_block"), "left")
    return joined.withColumn(mark, F.coalesce(test & F.col("_bits").isNotNull(), F.lit(False))).drop("_b", "_block", "_bits")


def without_stored(entries: DataFrame, stored: DataFrame, known: DataFrame, blocks: int, url: str = "link") -> DataFrame:
    """``entries`` whose URL is not in ``stored`` (article_url): those the filter excludes go past the join."""
    rows = marked(entries, known, blocks, url)
    gone = stored.select(F.col("article_url").alias("_url"))
    possible = rows.where("_maybe").join(gone, F.col(url) == F.col("_url"), "left_anti")
    return rows.where("not _maybe").unionByName(possible).drop("_maybe")


def with_stored(entries: DataFrame, content: DataFrame, known: DataFrame, blocks: int, url: str = "link") -> DataFrame:
    """``entries`` with ``existing_id`` and ``existing_image`` of the stored article, NULL when new; equal to ``split_by_stored_url``."""
    from newsweave.operators.articles import split_by_stored_url

    rows = marked(entries, known, blocks, url)
    kinds = {"existing_id": content.schema["id"].dataType, "existing_image": content.schema["image_url"].dataType}
    new = rows.where("not _maybe").select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    return new.unionByName(split_by_stored_url(rows.where("_maybe"), content, url)).drop("_maybe")
