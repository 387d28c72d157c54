"""Ingest of a stream of feed entries: the whole job in each micro-batch.

Entries are cleaned, classified and checked against the crawl status as they come. What is known of a URL is state, keyed by small buckets of
URLs (a Python call for each URL costs far more than its work): present means the article is stored or was inserted, and the value says whether
it has a picture. So a batch meets only the buckets of its own URLs; nothing that earlier batches wrote is read again but the last id they gave. The stored articles enter the state once, with the
first batch, and ``forget`` takes URLs out again that retention removed.

For a URL that is not known, the first eligible entry of the batch in round order is inserted, with the first picture that it or a
later entry of the batch brings; a known article without a picture takes the first one offered. Batches are written as
partitions that a replayed batch overwrites with the same rows. ``content`` gives the whole table as it is after any number of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from newsweave.functions.vocabulary import Vocabulary
from newsweave.operators import articles as A
from newsweave.operators.maintenance import within_lengths
from newsweave.plans.ingest import ROUND, entry_defaults, insert_new_articles, prepared
from newsweave.streaming.streams import run_to_table

#: Columns of an entry behind the stateless part; ``what`` is entry, stored or gone before the state and insert or picture behind it.
ENTRY = ("link string, pos long, source_name string, source_id long, title string, summary string, published_at timestamp, topic string, "
         "image_url string, method string, ai_used boolean, confidence double, reason string, eligible boolean, what string")
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
NAMED = {"what", "link", "image_url"}
LINKS = "what string, link string, image_url string"
#: Stored URLs of a bucket when the stream starts: what one Python call decides, and what a batch that meets one of them writes anew.
BUCKET_URLS = 256
STATE = "links array<string>, pictured array<boolean>"


def checked_entries(entries: DataFrame, url_status: DataFrame, as_of, vocab: Vocabulary | None = None, scores: str | None = None) -> DataFrame:
    """Clean, classified entries in the columns of ``ENTRY``; ``eligible`` ones may be inserted. Row by row, so it runs on a stream."""
    done = prepared(entry_defaults(entries, as_of), vocab, scores)
    up = url_status.where(F.col("status") == 200).select(F.col("url").alias("_url")).distinct()
    fits = A.has_topic() & within_lengths({"title": "title", "link": "article_url"})
    flagged = done.join(up, F.col("link") == F.col("_url"), "left").withColumns(
        {"eligible": fits & F.col("_url").isNotNull(), "what": F.lit("entry"), "pos": F.col("pos").cast("long"), "source_id": F.col("source_id").cast("long")})
    return flagged.select(*COLUMNS)


def decide(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """What the rows of one bucket of URLs in a batch lead to: rows to insert and pictures for known articles, at most one row for a URL."""
    rows = pd.concat(list(parts)).sort_values(ROUND, kind="stable")
    before = dict(zip(*state.get)) if state.exists else {}
    known = dict(before)
    whats, links, pictures = rows["what"].tolist(), rows["link"].tolist(), rows["image_url"].fillna("").tolist()
    for what, link, picture in zip(whats, links, pictures):
        if what == "stored":
            known[link] = known.get(link, False) or picture != ""
    for what, link in zip(whats, links):
        if what == "gone":
            known.pop(link, None)
    chosen: dict = {}
    for i, (what, link, picture, eligible) in enumerate(zip(whats, links, pictures, rows["eligible"].tolist())):
        if what != "entry":
            continue
        if link not in known:
            if not eligible:
                continue
            known[link], chosen[link] = False, [i, "insert", rows["image_url"].iat[i]]
        if not known[link] and picture:
            known[link] = True
            chosen.setdefault(link, [i, "picture", None])[2] = picture
    if known and known != before:
        state.update((list(known), list(known.values())))
    elif not known and state.exists:
        state.remove()
    if chosen:
        at, what, picture = zip(*chosen.values())
        yield rows.iloc[list(at)].assign(what=list(what), image_url=list(picture))[COLUMNS]


def buckets_of(content: DataFrame, out: str) -> int:
    """Buckets of the URLs in the state of the stream into ``out``: chosen for its first run by the number of stored articles, and kept beside it."""
    spark = content.sparkSession
    try:
        return spark.read.parquet(f"{out}/buckets").first()["n"]
    except AnalysisException:
        least = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(max(least, content.count() // BUCKET_URLS)).alias("n")).write.parquet(f"{out}/buckets")
        return buckets_of(content, out)


def seeded(spark: SparkSession, content: DataFrame, out: str) -> DataFrame:
    """Stream of what is known beforehand: the URLs and pictures of ``content``, written once, and what ``forget`` adds."""
    folder = f"{out}/links"
    try:
        spark.read.parquet(folder)
    except AnalysisException:
        content.select(F.lit("stored").alias("what"), F.col("article_url").alias("link"), "image_url").write.parquet(folder)
    return spark.readStream.schema(LINKS).parquet(folder)


def forget(urls: DataFrame, out: str) -> None:
    """Take articles (article_url) out of the state of the stream into ``out``: from its next run on their URLs are new. Call it when the
    entries that came before are through, so that a batch does not hold both."""
    urls.select(F.lit("gone").alias("what"), F.col("article_url").alias("link"), F.lit(None).cast("string").alias("image_url")).write.mode("append").parquet(f"{out}/links")


def ingest_stream(entries: DataFrame, content: DataFrame, url_status: DataFrame, as_of, out: str, vocab: Vocabulary | None = None,
                  scores: str | None = None, trigger: dict | None = None) -> str:
    """Run a stream of feed entries (source_id, source_name, pos, link, title, summary, published_at, image_url) into ``out``. ``content`` is the
    table that the first run starts from. Returns ``out``; ``streamed_content`` reads it."""
    spark = content.sparkSession
    fresh = checked_entries(entries, url_status, as_of, vocab, scores)
    # numbers instead of nulls, which would make floats of the entries' numbers in pandas
    blank = {"string": None, "timestamp": None, "long": 0, "double": 0.0, "boolean": False}
    links = seeded(spark, content, out).select(*[F.col(c) if c in NAMED else F.lit(blank[kind]).cast(kind).alias(c) for c, kind in (x.split() for x in ENTRY.split(", "))])
    bucket = F.pmod(F.xxhash64("link"), F.lit(buckets_of(content, out))).alias("bucket")
    decided = fresh.unionByName(links).select(bucket, "*").groupBy("bucket").applyInPandasWithState(decide, ENTRY, STATE, "append", GroupStateTimeout.NoTimeout)

    def each(batch: DataFrame, number: int) -> DataFrame:
        chosen = f"{out}/decided/batch={number}"
        batch.write.mode("overwrite").parquet(chosen)
        rows = spark.read.schema(ENTRY).parquet(chosen)
        before = spark.read.schema("top long").parquet(f"{out}/tops/batch={number - 1}") if number else content.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
        top = int(before.first()["top"])
        added = insert_new_articles(content, rows.where("what = 'insert'"), top)
        written = f"{out}/added/batch={number}"
        added.write.mode("overwrite").parquet(written)
        highest = spark.read.schema(added.schema).parquet(written).agg(F.coalesce(F.max("id"), F.lit(top)).alias("top"))
        highest.write.mode("overwrite").parquet(f"{out}/tops/batch={number}")
        return rows.where("what = 'picture'").select(F.col("link").alias("article_url"), "image_url")

    # the table of the run itself holds the pictures
    run_to_table(decided, out, each=each, trigger=trigger)
    return out


def streamed_content(content: DataFrame, out: str) -> DataFrame:
    """The table after the batches so far: the rows it started from and the added ones, with the pictures found since."""
    spark = content.sparkSession
    added = spark.read.parquet(f"{out}/added").drop("batch")
    if "published_on" in content.columns:
        added = added.withColumn("published_on", F.to_date("published_at"))
    found = spark.read.schema("article_url string, image_url string, batch int").parquet(f"{out}/table")
    first = found.groupBy(F.col("article_url").alias("_url")).agg(F.min_by("image_url", "batch").alias("_image"))
    rows = content.unionByName(added, allowMissingColumns=True)
    return (rows.join(first, F.col("article_url") == F.col("_url"), "left")
            .withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), "_image")).drop("_url", "_image"))
