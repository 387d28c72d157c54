"""Ingest of a batch of feed entries: clean, classify, choose, insert, backfill.

Entries of all feeds are one DataFrame. The reference order - one entry per feed and round,
feeds by source name - becomes a sort key (pos, source_name), so "first entry wins" and
"stop at the first round without an insert" are a window and one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import clock
from newsweave.functions import classify as C
from newsweave.functions.html import html_to_text
from newsweave.functions.images import entry_image
from newsweave.functions.text import computed_once, excerpt, strip_markup, strip_quotes
from newsweave.functions.vocabulary import Vocabulary
from newsweave.operators import articles as A
from newsweave.operators.maintenance import failed_run, job_result, retention_days, within_lengths
from newsweave.operators.ranking import first_per_group, position_in_group, top_k_per_group
from newsweave.session import cut_lineage
from newsweave.sources.feeds import parse_feed_xml
from newsweave.sources.tables import Tables

FEED_CAP = 10
ROUND = ["pos", "source_name", "source_id"]


def entry_defaults(entries: DataFrame, as_of, published: str = "published_at") -> DataFrame:
    """Missing link, title and date of an entry."""
    return entries.withColumns({
        "link": F.coalesce("link", F.lit("")), "title": F.coalesce("title", F.lit("No Title")),
        published: F.coalesce(published, clock.instant(as_of))})


def feed_cap(entries: DataFrame, cap: int | None = FEED_CAP) -> DataFrame:
    """First ``cap`` entries of each feed, all with None; ``pos`` is the 0-based place in the document."""
    return entries if cap is None else entries.where(F.col("pos") < cap)


def feed_cap_unplaced(entries: DataFrame, order: list[Column], cap: int = FEED_CAP) -> DataFrame:
    """Same for entries that only have an order: ``pos`` is added."""
    return top_k_per_group(entries, ["source_id"], order, cap, "_n").withColumn("pos", F.col("_n") - 1).drop("_n")


def reachable(entries: DataFrame, url_status: DataFrame, url: str = "link") -> DataFrame:
    """Entries whose URL answered 200 in the crawl status table (url, status)."""
    up = url_status.where(F.col("status") == 200).select(F.col("url").alias("_url"))
    return entries.join(up, F.col(url) == F.col("_url"), "left_semi")


def first_wins_by_url(entries: DataFrame, url: str = "link") -> DataFrame:
    """One entry per URL: the first in round order."""
    return first_per_group(entries, [url], [F.col(c) for c in ROUND])


def not_stored(entries: DataFrame, stored: DataFrame, url: str = "link") -> DataFrame:
    """Entries whose URL is not in ``stored`` (article_url)."""
    return entries.join(stored.select(F.col("article_url").alias("_url")), F.col(url) == F.col("_url"), "left_anti")


def last_round(winners: DataFrame) -> DataFrame:
    """One row, ``stop``: the first round that inserts nothing, found among the places behind a round that does."""
    rounds = winners.select(F.col("pos").cast("long").alias("pos")).distinct()
    after = rounds.select((F.col("pos") + 1).alias("pos")).unionByName(winners.sparkSession.range(1).select(F.col("id").alias("pos")))
    return after.join(rounds, "pos", "left_anti").agg(F.min("pos").alias("stop"))


def round_robin(eligible: DataFrame, stored: DataFrame, url: str = "link") -> DataFrame:
    """Entries that get inserted, with their round in ``pos``."""
    winners = not_stored(first_wins_by_url(eligible, url), stored, url)
    return winners.where(F.col("pos") < last_round(winners).scalar())


def prepared(entries: DataFrame, vocab: Vocabulary | None = None, scores: str | None = None) -> DataFrame:
    """Entries with clean excerpt as ``summary`` and the classifier's verdict on (title, excerpt)."""
    cut = computed_once(entries, _cut=excerpt(strip_markup("summary")))
    return C.classify(cut.withColumn("summary", F.col("_cut")).drop("_cut"), vocab, scores=scores)


def feed_entries(parsed: DataFrame) -> DataFrame:
    """Parsed feed entries with plain text and picture: ``summary`` holds the text nodes, joined by one space, of the first
    content, else of the summary, else the title; ``image_url`` is the first valid picture by precedence."""
    full = F.get(F.filter(F.transform("content", lambda c: c["value"]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    none = F.lit(None).cast("struct<href:string>")
    image = F.col("image") if "image" in parsed.columns else none
    text = F.coalesce(F.nullif(html_to_text(full), F.lit("")), F.nullif(html_to_text("summary"), F.lit("")), F.col("title"))
    picture = entry_image(F.col("media_content"), F.col("media_thumbnail"), F.col("enclosures"), image, F.col("content"), F.col("summary"))
    made = computed_once(parsed, _text=text, _picture=picture)
    return made.withColumns({"summary": F.col("_text"), "image_url": F.col("_picture")}).drop(
        "_text", "_picture", "content", "media_content", "media_thumbnail", "enclosures", "image")


def ingest_feeds(t: Tables, documents: DataFrame, url_status: DataFrame, as_of, **options) -> "IngestResult":
    """A whole run from feed documents (source_id, source_name, xml) to the new content table."""
    entries = feed_entries(parse_feed_xml(documents, keep=("source_id", "source_name")))
    return ingest(t, entries, url_status, as_of, **options)


def logged_run(spark, job, as_of) -> DataFrame:
    """Run-log row of ``job()``, an ``IngestResult``: of a success, or with the error of a failure. Runs the job."""
    try:
        return cut_lineage(job().run)
    except Exception as error:  # noqa: BLE001 - whatever ends a run is logged
        return failed_run(spark, f"{type(error).__name__}: {str(error).splitlines()[0][:500]}", as_of)


def insert_new_articles(content: DataFrame, chosen: DataFrame, top: int | None = None) -> DataFrame:
    """``chosen`` entries as content rows with the next ids in insertion order, behind ``top`` or the largest id of ``content``."""
    keys = chosen.select("link", *ROUND)
    placed = position_in_group(keys, [], [F.col(c) for c in ROUND], "_n").select("link", "_n")
    top = content.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar() if top is None else F.lit(top)
    return chosen.join(placed, "link").select(
        (top + F.col("_n")).cast("long").alias("id"), "source_id", "title", strip_quotes("summary").alias("summary"),
        F.col("link").alias("article_url"), "published_at", "topic", "image_url",
        F.col("method").alias("classification_method"), F.col("confidence").cast("decimal(4,3)").alias("ai_confidence_score"),
        C.metadata().alias("classification_metadata"))


def backfill_image(content: DataFrame, entries: DataFrame, url: str = "link") -> DataFrame:
    """Stored articles without a picture take the first one an entry with the same URL brings."""
    offered = (entries.where(F.coalesce("image_url", F.lit("")) != "")
               .groupBy(F.col(url).alias("_url")).agg(F.min_by("image_url", F.struct(*ROUND)).alias("_image")))
    return (content.join(offered, F.col("article_url") == F.col("_url"), "left")
            .withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), "_image")).select(*content.columns))


@dataclass(frozen=True)
class IngestResult:
    """New content table, the rows added to it, and the run-log row."""

    content: DataFrame
    added: DataFrame
    run: DataFrame


def ingest(t: Tables, feed_items: DataFrame, url_status: DataFrame, as_of, vocab: Vocabulary | None = None,
           cap: int | None = FEED_CAP, scores: str | None = None, rounds: bool = True) -> IngestResult:
    """One run over ``feed_items`` (source_id, source_name, pos, link, title, summary, published_at,
    image_url): old articles go, new ones come in round robin, missing pictures are filled. Without ``rounds`` the run
    does not end at the first round that inserts nothing."""
    kept = retention_days(t, as_of)
    # the entries are chosen from and offer pictures: parsed, cleaned and classified once
    entries = cut_lineage(prepared(entry_defaults(feed_cap(feed_items, cap), as_of), vocab, scores))
    fits = within_lengths({"title": "title", "link": "article_url"})
    eligible = reachable(entries.where(A.has_topic() & fits), url_status)
    # used four times below: classified and chosen once
    winners = cut_lineage(not_stored(first_wins_by_url(eligible), kept.select("article_url")))
    stop = last_round(winners).scalar()
    chosen = winners.where(F.col("pos") < stop) if rounds else winners
    added = insert_new_articles(t.content, chosen)
    # every entry of the rounds that ran may offer a picture; for an article added in this run only
    # the entries after it do
    seen = entries.where(F.col("pos") <= stop) if rounds else entries
    turn = F.struct(*ROUND)
    started = chosen.select("link", turn.alias("_turn"))
    late = seen.join(started, "link", "left").where(F.col("_turn").isNull() | (turn >= F.col("_turn"))).drop("_turn")
    if "published_on" in kept.columns:
        added = added.withColumn("published_on", F.to_date("published_at"))
    content = backfill_image(kept.unionByName(added, allowMissingColumns=True), late)
    return IngestResult(content, added, job_result(added, as_of))
