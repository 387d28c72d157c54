"""The filter over stored URLs: exact results whatever its size, few rows in the exact join."""

import pytest
from pyspark.sql import functions as F

from newsweave.operators import articles as A
from newsweave.operators import url_filter as U
from newsweave.plans.ingest import not_stored


@pytest.fixture(scope="module")
def tables(spark):
    content = spark.range(20_000).select("id", F.concat(F.lit("https://s.example.com/ä/"), F.col("id").cast("string")).alias("article_url"),
                                         F.when(F.col("id") % 3 == 0, F.lit("x")).alias("image_url"))
    link = F.when(F.col("id") % 20 == 0, F.concat(F.lit("https://s.example.com/ä/"), F.col("id").cast("string"))).when(
        F.col("id") % 501 != 7, F.concat(F.lit("https://n.example.com/"), F.col("id").cast("string")))
    return content, spark.range(40_000).select(F.col("id").alias("k"), link.alias("link"))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("blocks", [1, 4, None, 5000])
def test_exact(spark, tables, blocks):
    content, entries = tables
    blocks = blocks or U.blocks_for(20_000)
    known = U.build(content, blocks)
    assert known.count() <= blocks and {len(r["bits"]) for r in known.collect()} == {4096}
    assert rows(U.with_stored(entries, content, known, blocks).select("k", "link", "existing_id", "existing_image")) == \
        rows(A.split_by_stored_url(entries, content).select("k", "link", "existing_id", "existing_image"))
    assert rows(U.without_stored(entries, content, known, blocks).select("k", "link")) == rows(not_stored(entries, content).select("k", "link"))


def test_share_that_skips_the_join(spark, tables):
    """Of 39,000 new entries at most 0.5 % meet the stored table, and every stored URL does."""
    content, entries = tables
    blocks = U.blocks_for(20_000)
    found = U.marked(entries, U.build(content, blocks), blocks).select("_maybe", F.col("link").startswith("https://s").alias("old"), "k")
    n = {(r["_maybe"], r["old"]): r["count"] for r in found.where("link is not null or true").groupBy("_maybe", "old").count().collect()}
    stored = entries.where("k < 20000 and k % 20 = 0").count()
    assert n[True, True] >= stored
    assert n.get((True, False), 0) <= 0.005 * n[False, False]
    assert found.where("old is null and _maybe").count() == 0


def test_extended_by_inserts(spark, tables):
    content, entries = tables
    blocks = U.blocks_for(20_000)
    parts = [content.where(F.col("id") % 3 == i) for i in range(3)]
    known = U.build(parts[2], blocks)
    for p in (parts[0], parts[1], parts[0]):
        known = U.extended(known, p, blocks)
    bits = lambda df: sorted((r["block"], bytes(r["bits"])) for r in df.collect())
    assert bits(known) == bits(U.build(content, blocks))
    empty = U.build(content.limit(0), blocks)
    assert U.marked(entries, empty, blocks).where("_maybe").count() == 0
