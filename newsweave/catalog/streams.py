"""Streams over the given files, run to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.maintain import ingest_sql, known_tables, raw_entries
from newsweave.catalog.pages import feed_documents, parsed_columns
from newsweave.catalog.registry import ORACLE, query
from newsweave.catalog.views import AS_OF as NOW
from newsweave.catalog.views import sql
from newsweave.operators.maintenance import retention_days
from newsweave.plans.ingest import entry_defaults
from newsweave.session import configure, cut_lineage
from newsweave.sources import feed_source as X
from newsweave.sources import sample as S
from newsweave.sources.feeds import parse_feed_xml
from newsweave.streaming import ingest as G
from newsweave.streaming import streams as W


def event_stream(spark, d):
    return W.read_files(configure(spark), d, S.SCHEMAS["events"], "events.parquet")


def command_stream(spark, d):
    """Events as reader commands with the topic of the article."""
    n = S.read(spark, d, "documents").count()
    kind = F.col("event_type")
    cid = F.col("event_id") % n
    return event_stream(spark, d).select(
        "event_id", "user_id", cid.alias("content_id"), S.topic_of(cid % 9).alias("topic"), "event_type",
        F.when(kind.isin("view", "click"), F.lit(True)).when(kind == "error", F.lit(False)).alias("is_read"),
        F.when(kind == "purchase", F.lit(True)).when(kind == "signup", F.lit(False)).alias("is_liked"),
        F.col("ts").alias("interaction_at"))


@query("select distinct 'https://news.example.com/' || event_type || '/' || user_id || '?' || coalesce(props, '') as article_url from events")
def stream_dedup_articles(spark, d):
    """Arrivals of an address made from kind, reader and properties of an event."""
    url = F.concat(F.lit("https://news.example.com/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit("?"), F.coalesce("props", F.lit("")))
    arrivals = event_stream(spark, d).select("ts", url.alias("article_url"))
    table = W.run_to_table(W.dedup_articles(arrivals, "ts"), W.new_output(spark, "dedup"))
    return spark.read.parquet(table).select("article_url")


WHOLE = "id, source_id, title, summary, article_url, published_at, topic, image_url, classification_method, ai_confidence_score"


@query(ingest_sql(f"""select id, source_id, title, summary, article_url, published_at, topic, coalesce(nullif(image_url, ''), first_image) as image_url,
 cast(null as varchar) as classification_method, cast(null as decimal(4,3)) as ai_confidence_score from kept left join firsts on link = article_url
 union all select (select max(id) from content) + row_number() over (order by pos, source_name), source_id, title, replace(replace(summary, '"', ''), chr(39), ''),
 link, {NOW}, topic, image, method, cast(confidence as decimal(4,3)) from inserts left join pictures using (doc_id)""", None, "known",
                   offered="select link, pos, source_name, 'https://img.example.com/' || doc_id || '.jpg' as image from feed_items where doc_id % 2 = 0",
                   firsts="select link, arg_min(image, row(pos, source_name)) as first_image from offered group by link",
                   pictures="""select i.doc_id, arg_min(o.image, row(o.pos, o.source_name)) as image from inserts i
 join offered o on o.link = i.link and (o.pos > i.pos or o.pos = i.pos and o.source_name >= i.source_name) group by i.doc_id"""))
def stream_ingest(spark, d):
    """Raw entries arrive in four deliveries, in round order, one per run of the stream; the whole table behind them."""
    content = cut_lineage(retention_days(known_tables(spark, d), S.AS_OF))
    entries = cut_lineage(raw_entries(spark, d).select("source_id", "source_name", "pos", "link", "title", "summary", "published_at", "image_url"))
    inbox, out = W.new_output(spark, "inbox"), W.new_output(spark, "ingest")
    status = cut_lineage(S.url_status(spark, d))
    rounds = entries.agg(F.max("pos")).first()[0] // 4 + 1
    for i in range(4):
        # as many files as the entries have partitions: no task holds a delivery
        entries.where(F.col("pos").between(i * rounds, i * rounds + rounds - 1)).write.mode("append").parquet(inbox)
        G.ingest_stream(W.read_files(spark, inbox, entries.schema), content, status, S.AS_OF, out)
    return G.streamed_content(content, out).select(*WHOLE.split(", "))


@query(sql("interactions", "select user_id, content_id, is_read, is_liked, interaction_at from interactions"))
def stream_fold_interactions(spark, d):
    return W.fold_stream(command_stream(spark, d), W.new_output(spark, "fold"))


TOPICAL = """select e.*, t.topic, event_type in ('view', 'click') as seen from events e cross join (select count(*) as n from documents) n
 left join topic_dim t on t.k = (e.event_id % n.n) % 9"""


@query(sql("topic_dim", """select cast(ts as date) as date, topic, count(*) as interaction_count, count(*) filter (where seen) as view_count from topical group by 1, 2""", topical=TOPICAL))
def stream_topic_trends(spark, d):
    table = W.run_to_table(W.daily_topic_counts(command_stream(spark, d), "interaction_at"), W.new_output(spark, "daily"), "update")
    return W.latest(spark.read.parquet(table), ["date", "topic"])


@query(sql("topic_dim", """select s as window_start, s + interval 24 hour as window_end, topic, count(*) as interaction_count from
 (select topic, unnest(list_transform(range(0, 24), lambda i: date_trunc('hour', ts) - to_hours(i))) as s from topical) group by s, topic""", topical=TOPICAL))
def stream_trending(spark, d):
    table = W.run_to_table(W.sliding_topic_counts(command_stream(spark, d), "interaction_at"), W.new_output(spark, "sliding"), "update")
    return W.latest(spark.read.parquet(table), ["window_start", "window_end", "topic"])


@query("""select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as events,
 max(ts) + interval 30 minute > (select date_trunc('millisecond', max(ts)) - interval 1 hour from events) as still_open from
 (select *, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts, event_id) as n from
  (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute, true) as gap from events))
 group by user_id, n""")
def stream_sessions(spark, d):
    """Closed sessions from the stream, and from its state those still open at its end."""
    out = W.new_output(spark, "sessions")
    closed = spark.read.parquet(W.run_to_table(W.reader_sessions(event_stream(spark, d), "ts"), out)).select("user_id", "session_start", "session_end", "events")
    still = W.open_sessions(spark, out)
    return closed.withColumn("still_open", F.lit(False)).unionByName(still.withColumn("still_open", F.lit(True)))


def written_feeds(spark, d, folder, part):
    """Half of the feed documents as files, numbered within their feed."""
    docs = feed_documents(spark, d).where(F.col("part") % 2 == part)
    docs.select("source_id", (F.col("part") + part * 1_000_000).alias("number"), "xml").repartition("source_id", "number").write.mode("append").partitionBy("source_id", "number").option(
        # each task puts its many files in place itself instead of leaving all of them to the driver
        "mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)


@query(ORACLE["parse_feed_xml"])
def stream_feed_documents(spark, d):
    """Documents from the feed source, half of them before and half after the stream is stopped, parsed as they come."""
    folder, out = W.new_output(spark, "feeds"), W.new_output(spark, "entries")
    for half in (0, 1):
        # numbers rise: the second half lies behind the first of every feed
        written_feeds(spark, d, folder, half)
        documents = X.feed_documents(configure(spark), folder, stream=True, documents_per_task=2)
        entries = entry_defaults(parse_feed_xml(documents), S.AS_OF)
        W.run_to_table(entries, out)
    return parsed_columns(spark.read.schema(entries.schema).parquet(f"{out}/table"))
