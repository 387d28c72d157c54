"""Feed documents: the registry of feeds and the parser for RSS and Atom batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The feeds a fresh installation follows.
FEEDS = [
    ("TechCrunch", "https://techcrunch.com/feed/"),
    ("Ars Technica", "https://feeds.arstechnica.com/arstechnica/index"),
    ("Hacker News", "https://hnrss.org/frontpage"),
    ("TechRadar", "https://www.techradar.com/rss"),
    ("ZDNet", "https://www.zdnet.com/news/rss.xml"),
    ("MIT Technology Review", "https://www.technologyreview.com/feed/"),
    ("Engadget", "https://www.engadget.com/rss.xml"),
    ("9to5Mac", "https://9to5mac.com/feed/"),
    ("Android Police", "https://www.androidpolice.com/feed/"),
    ("Mashable Tech", "https://mashable.com/feeds/rss/all"),
    ("CNET", "https://www.cnet.com/rss/news/"),
    ("IEEE Spectrum", "https://spectrum.ieee.org/rss/fulltext"),
    ("NYT Technology", "https://rss.nytimes.com/services/xml/rss/nyt/Technology.xml"),
    ("Gizmodo", "https://gizmodo.com/feed"),
    ("AI News", "https://www.artificialintelligence-news.com/feed/"),
    ("OpenAI Blog", "https://openai.com/blog/rss.xml"),
    ("KrebsOnSecurity", "https://krebsonsecurity.com/feed/"),
    ("Dark Reading", "https://www.darkreading.com/rss.xml"),
    ("GitHub Blog", "https://github.blog/feed/"),
    ("Stack Overflow Blog", "https://stackoverflow.blog/feed/"),
    ("Dev.to", "https://dev.to/feed"),
    ("Opensource.com", "https://opensource.com/feed"),
    ("KDnuggets", "https://www.kdnuggets.com/feed"),
    ("CoinDesk", "https://www.coindesk.com/arc/outboundfeeds/rss/"),
    ("EFF Deeplinks", "https://www.eff.org/rss/updates.xml"),
]

_RSS_ITEM = ("struct<title:string,link:string,description:string,pubDate:string,`content:encoded`:string,"
             "`media:content`:array<struct<_url:string>>,`media:thumbnail`:array<struct<_url:string>>,"
             "enclosure:array<struct<_url:string>>>")
_ATOM_ENTRY = ("struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,"
               "published:string,updated:string>")
_DOCUMENT = f"channel struct<item:array<{_RSS_ITEM}>>, entry array<{_ATOM_ENTRY}>"


def feed_registry(spark: SparkSession) -> DataFrame:
    """(name, url) of the followed feeds."""
    return spark.createDataFrame(FEEDS, "name string, url string")


def feed_time(text: Column) -> Column:
    """RFC 822 or ISO 8601 date text as an instant, NULL when it is neither."""
    plain = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, *", "")
    zone = F.regexp_replace(plain, " (?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(text)))


def parse_feed_xml(documents: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Entries of a batch of feed documents: kept columns, ``pos`` (0-based place in the document),
    link, title, summary, published_at, content, media arrays. A document that is not XML gives
    no entry. RSS items and Atom entries come out in one shape."""
    doc = F.from_xml(F.col(xml), _DOCUMENT, {"mode": "PERMISSIVE", "ignoreNamespace": "false"})
    none = lambda t: F.lit(None).cast(t)
    urls = lambda c, name: F.transform(c, lambda m: F.struct(m["_url"].alias(name)))
    value = lambda c: F.when(c.isNotNull(), F.array(F.struct(c.alias("value"))))
    rss = F.transform(F.col("_doc.channel.item"), lambda i: F.struct(
        F.trim(i["link"]).alias("link"), i["title"].alias("title"), i["description"].alias("summary"),
        feed_time(i["pubDate"]).alias("published_at"), value(i["content:encoded"]).alias("content"),
        urls(i["media:content"], "url").alias("media_content"), urls(i["media:thumbnail"], "url").alias("media_thumbnail"),
        urls(i["enclosure"], "href").alias("enclosures")))
    main_link = lambda e: F.get(F.filter(e["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    media = "array<struct<url:string>>"
    atom = F.transform(F.col("_doc.entry"), lambda e: F.struct(
        main_link(e).alias("link"), e["title"].alias("title"), e["summary"].alias("summary"),
        feed_time(F.coalesce(e["published"], e["updated"])).alias("published_at"), value(e["content"]).alias("content"),
        none(media).alias("media_content"), none(media).alias("media_thumbnail"),
        none("array<struct<href:string>>").alias("enclosures")))
    return (documents.select(*keep, doc.alias("_doc"))
            .select(*keep, F.posexplode(F.coalesce(rss, atom)).alias("pos", "_e")).select(*keep, "pos", "_e.*"))


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items straight from files, one row per item, split across tasks by the XML reader."""
    return spark.read.format("xml").option("rowTag", "item").load(path)
