"""Ingest, retention, sync, patch and expiry queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsweave.catalog.registry import query
from newsweave.catalog.text import EXCERPT, STRIP, classified_sql
from newsweave.catalog.views import AS_OF as NOW
from newsweave.catalog.views import sql
from newsweave.operators import articles as A
from newsweave.operators import maintenance as M
from newsweave.operators import url_filter as U
from newsweave.plans import ingest as G
from newsweave.schemas import TABLES
from newsweave.schemas import create_tables as make_tables
from newsweave.session import cut_lineage, scratch_path
from newsweave.sources import sample as S
from newsweave.sources.feeds import FEEDS
from newsweave.sources.rewrite import delete_rows
from newsweave.sources.sample import AS_OF
from newsweave.sources.sinks import replace_partitions
from newsweave.sources.tables import Tables

# -- ingest ----------------------------------------------------------------------------


@query(sql("feed_items", "select source_id, doc_id, pos, link from feed_items where pos < 10"))
def feed_cap(spark, d):
    entries = S.feed_links(spark, d).select("source_id", "doc_id", "link")
    return G.feed_cap_unplaced(entries, [F.col("doc_id").desc()]).withColumn("pos", F.col("pos").cast("long"))


KNOWN = "select * replace (case when id % 4 = 0 then 'https://news.example.com/a/' || id else article_url end as article_url) from content"


def known_tables(spark, d):
    """All stored articles; every fourth has the URL under which a feed names it, so some entries are known."""
    named = F.concat(F.lit("https://news.example.com/a/"), F.col("id").cast("string"))
    t = S.tables(spark, d)
    return t.with_(content=t.content.withColumn("article_url", F.when(F.col("id") % 4 == 0, named).otherwise(F.col("article_url"))))


@query(sql("feed_items content", "select f.doc_id, f.link, c.id as existing_id, c.image_url as existing_image from feed_items f left join known c on c.article_url = f.link", known=KNOWN))
def lookup_existing_url(spark, d):
    """All stored rows; only entries that the filter over the stored URLs lets through meet them."""
    content = known_tables(spark, d).content
    known, blocks = url_filter(content.select("article_url"))
    return U.with_stored(S.feed_links(spark, d), content, known, blocks).select("doc_id", "link", "existing_id", "existing_image")


def url_filter(stored):
    """Filter over stored URLs, written beside them, made from one half and extended by the other."""
    blocks = U.blocks_for(stored.count())
    half = F.pmod(F.xxhash64("article_url"), F.lit(2)) == 0
    return cut_lineage(U.extended(U.build(stored.where(half), blocks), stored.where(~half), blocks)), blocks


@query(sql("feed_items url_status", "select f.doc_id, f.link from feed_items f join url_status u on u.url = f.link where u.status = 200"))
def reachability_filter(spark, d):
    return G.reachable(S.feed_links(spark, d), S.url_status(spark, d)).select("doc_id", "link")


WINNERS = """select * from (select f.*, row_number() over (partition by link order by pos, source_name) as rn from feed_items f join url_status u on u.url = f.link
 where u.status = 200 and f.topic is not null) where rn = 1"""
INSERTS = "select w.* from winners w where link not in (select article_url from stored)"
ROUNDS = """select * from inserts where pos < (select min(p.pos + 1) from (select -1 as pos union all select distinct pos from inserts) p
 where p.pos + 1 not in (select pos from inserts))"""


def eligible(spark, d):
    return G.reachable(S.feed_items(spark, d).where(A.has_topic()), S.url_status(spark, d))


@query(sql("feed_items url_status", "select link, doc_id, pos from winners", winners=WINNERS))
def first_wins_by_url(spark, d):
    return G.first_wins_by_url(eligible(spark, d)).select("link", "doc_id", F.col("pos").cast("long").alias("pos"))


@query(sql("feed_items url_status stored", "select link, doc_id, source_name, pos as round from rounds", winners=WINNERS, inserts=INSERTS, rounds=ROUNDS))
def round_robin_ingest(spark, d):
    return G.round_robin(eligible(spark, d), S.stored_urls(spark, d)).select("link", "doc_id", "source_name", F.col("pos").cast("long").alias("round"))


@query(sql("feed_items url_status stored content", """select (select max(id) from content) + row_number() over (order by pos, source_name) as id, source_id, link as article_url, topic,
 replace(replace(summary, '"', ''), '''', '') as summary from rounds""", winners=WINNERS, inserts=INSERTS, rounds=ROUNDS))
def insert_new_articles(spark, d):
    stored = S.stored_urls(spark, d)
    known, blocks = url_filter(stored)
    new = cut_lineage(U.without_stored(G.first_wins_by_url(eligible(spark, d)), stored, known, blocks))
    chosen = new.where(F.col("pos") < G.last_round(new).scalar()).withColumns({
        "published_at": F.lit(AS_OF).cast("timestamp"), "image_url": F.lit(None).cast("string"), "method": F.lit("manual"),
        "ai_used": F.lit(False), "confidence": F.lit(None).cast("double"), "reason": F.lit("Pre-assigned topic")})
    return G.insert_new_articles(S.content(spark, d), chosen).select("id", "source_id", "article_url", "topic", "summary")


@query(sql("content feed_items", """select c.id, coalesce(nullif(c.image_url, ''), o.image) as image_url from content c left join
 (select link, arg_min(image, row(pos, source_name)) as image from offers where image is not null and image <> '' group by link) o on o.link = 'https://news.example.com/a/' || c.id""",
           offers="select *, case when doc_id % 2 = 0 then 'https://img.example.com/' || doc_id || '.jpg' else '' end as image from feed_items"))
def backfill_image(spark, d):
    stored = S.content(spark, d).withColumn("article_url", F.concat(F.lit("https://news.example.com/a/"), F.col("id").cast("string")))
    offers = S.feed_items(spark, d).withColumn("image_url", F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("https://img.example.com/"), F.col("doc_id").cast("string"), F.lit(".jpg"))).otherwise(F.lit("")))
    return G.backfill_image(stored, offers).select("id", "image_url")


TITLES = ["Python code review for cloud software. ", "Security patch for Linux servers. ", "Open source robotics platform. ", "Docker on the web. ",
          "Housing policy of the minister. ", ""]


def raw_entries(spark, d):
    """Feed entries as they arrive: no topic, a telling title on most, a picture on every second one."""
    k = F.col("doc_id")
    words = F.get(F.array(*[F.lit(w) for w in TITLES]), (k % 6).cast("int"))
    picture = F.when(k % 2 == 0, F.concat(F.lit("https://img.example.com/"), k.cast("string"), F.lit(".jpg")))
    return S.feed_items(spark, d).drop("topic").withColumns({"title": F.concat(words, "title"), "published_at": F.lit(None).cast("timestamp"), "image_url": picture})


def run_ingest(spark, d, cap: int | None = G.FEED_CAP):
    return G.ingest(S.tables(spark, d), raw_entries(spark, d), S.url_status(spark, d), AS_OF, cap=cap)


def ingest_sql(body: str, cap: int | None = G.FEED_CAP, table: str = "content", **views: str) -> str:
    titled = f"select * exclude (title, topic), [{', '.join(repr(w) for w in TITLES)}][cast(doc_id % 6 as int) + 1] || title as title from feed_items"
    cut = f"select * exclude (s, summary), {EXCERPT} as summary from (select *, {STRIP.replace('{c}', 'summary')} as s from titled{f' where pos < {cap}' if cap else ''})"
    verdict = classified_sql(source="cut", key="doc_id")
    winners = """select * from (select f.*, v.topic, v.method, v.confidence, row_number() over (partition by link order by pos, source_name) as rn
     from cut f join verdict v on v.id = f.doc_id join url_status u on u.url = f.link
     where u.status = 200 and v.topic is not null and length(f.title) <= 255 and length(f.link) <= 255) where rn = 1"""
    inserts = "select w.* from winners w where link not in (select article_url from kept)"
    kept = f"select * from {table} where not (coalesce(published_at < {NOW} - interval 720 hour, false) and id not in (select content_id from likes))"
    own = {"known": KNOWN} if table == "known" else {}
    return sql("feed_items url_status content likes", body, **own, titled=titled, cut=cut, verdict=verdict, winners=winners, kept=kept, inserts=inserts, rounds=ROUNDS, **views)


ADDED = """select (select max(id) from content) + row_number() over (order by pos, source_name) as id, source_id, title,
 replace(replace(summary, '"', ''), '''', '') as summary, link as article_url, topic, method as classification_method,
 cast(confidence as decimal(4,3)) as ai_confidence_score from rounds"""


@query(ingest_sql(ADDED, None))
def ingest_all_entries(spark, d):
    """The ingest without a cap on the entries of a feed."""
    return run_ingest(spark, d, None).added.select("id", "source_id", "title", "summary", "article_url", "topic", "classification_method", "ai_confidence_score")


@query(ingest_sql(ADDED))
def ingest_batch(spark, d):
    return run_ingest(spark, d).added.select("id", "source_id", "title", "summary", "article_url", "topic", "classification_method", "ai_confidence_score")


def feeds_of_documents(spark, d):
    """Feed documents of at most 200 entries, each a feed of its own, and the crawl status of their links."""
    from newsweave.catalog.pages import feed_documents

    feeds = feed_documents(spark, d).select((F.col("source_id") * 100000 + F.col("part")).alias("source_id"),
                                            F.concat_ws("/", F.lpad(F.col("source_id").cast("string"), 4, "0"), F.lpad(F.col("part").cast("string"), 9, "0")).alias("source_name"), "xml")
    k = F.col("doc_id")
    status = S.read(spark, d, "documents").select(F.concat(F.lit("https://news.example.com/a/"), k.cast("string")).alias("url"),
                                                  F.when(k % 11 == 0, 404).otherwise(200).alias("status"))
    return feeds, status


@query(sql("content likes", """select link as article_url, title, summary, topic, method as classification_method, image from rounds
 union all select article_url, title, summary, topic, null, image_url from kept""",
           entries="""select cast(substr(source, 4) as int) * 100000 + doc_id // 200 as source_id, lpad(substr(source, 4), 4, '0') || '/' || lpad(cast(doc_id // 200 as varchar), 9, '0') as source_name,
 row_number() over (partition by source, doc_id // 200 order by doc_id) - 1 as pos, 'https://news.example.com/a/' || doc_id as link, 'Title ' || doc_id as title, doc_id,
 regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f]', '', 'g') as raw,
 case when cast(substr(source, 4) as int) % 2 = 0 then 'https://cdn.example.com/' || doc_id || '.jpg' end as image from documents""",
           cut=f"""select * exclude (s), case when raw = '' then title else {EXCERPT} end as summary from (select *, {STRIP.replace('{c}', 'raw')} as s from entries where pos < 10)""",
           verdict=classified_sql(source="cut", key="doc_id"),
           kept=f"select * from content where not (coalesce(published_at < {NOW} - interval 720 hour, false) and id not in (select content_id from likes))",
           inserts="""select f.* replace (replace(replace(f.summary, '"', ''), '\'\'', '') as summary), v.topic, v.method from cut f join verdict v on v.id = f.doc_id
 where f.doc_id % 11 <> 0 and v.topic is not null""".replace("'\'\''", "chr(39)"),
           rounds=ROUNDS))
def ingest_pipeline(spark, d):
    """From feed documents to the new content table: the kept rows and the added ones, whole."""
    feeds, status = feeds_of_documents(spark, d)
    run = G.ingest_feeds(S.tables(spark, d), feeds, status, AS_OF)
    return run.content.select("article_url", "title", "summary", "topic", "classification_method", F.col("image_url").alias("image"))


@query(ingest_sql(f"select true as success, count(*) as articles_added, cast(null as varchar) as error, {NOW} as run_at from rounds"))
def job_result(spark, d):
    return run_ingest(spark, d).run


RUNS = """select cast(ts as date) as day, max(ts) as run_at, count(*) filter (where event_type = 'error') < 80 as success from events group by 1"""


@query(f"select max(run_at) as last_ingested_at from ({RUNS}) where success")
def high_water_mark(spark, d):
    """Daily runs made from events; days with many errors count as failed."""
    runs = S.read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.max("ts").alias("run_at"), (F.count_if(F.col("event_type") == "error") < 80).alias("success"))
    return M.high_water_mark(runs)


@query(sql("content sources", """select 'content' as name, c.id, c.source_id, c.title, c.article_url, c.published_at, cast(c.published_at as date) as published_on from content c
 union all select 'sources', id, null, source_name, feed_url, null, null from sources"""))
def create_tables(spark, d):
    """The model tables made in a database of their own, filled and read back."""
    name, place = f"model_{uuid.uuid4().hex}", scratch_path(spark, "database")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{place}'")
    make_tables(spark, name)
    t = S.tables(spark, d)
    for table, rows in (("sources", t.sources), ("content", t.content.withColumn("published_on", F.to_date("published_at")))):
        fields = TABLES[table][0]
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.insertInto(f"{name}.{table}")
    stored = Tables.from_catalog(spark, name)
    none = F.lit(None)
    return stored.content.select(F.lit("content").alias("name"), "id", "source_id", "title", "article_url", "published_at", "published_on").unionByName(
        stored.sources.select(F.lit("sources").alias("name"), "id", none.cast("long").alias("source_id"), F.col("source_name").alias("title"), F.col("feed_url").alias("article_url"),
                              none.cast("timestamp").alias("published_at"), none.cast("date").alias("published_on")))


# -- retention -------------------------------------------------------------------------

LIKED_OUT = "id not in (select content_id from likes)"


@query(sql("content likes", f"""select count(*) filter (where cast(published_at as date) = cast({NOW} as date)) as fresh_today,
 count(*) filter (where cast(published_at as date) = cast({NOW} as date) - 1) as yesterday_count, count(*) as total_available from content where {LIKED_OUT}"""))
def retention_counts(spark, d):
    return M.retention_counts(S.tables(spark, d), AS_OF)


FEW = "select distinct content_id from interactions where is_liked"
RULE = f"""select *, case when fresh_today >= 10 then {NOW} - interval 24 hour when fresh_today > 0 and total_available > 20 then {NOW} - interval 48 hour end as cutoff from
 (select count(*) filter (where cast(published_at as date) = cast({NOW} as date)) as fresh_today,
 count(*) filter (where cast(published_at as date) = cast({NOW} as date) - 1) as yesterday_count, count(*) as total_available
 from content where id not in (select content_id from few))"""


@query(sql("content interactions", "select id, published_at from content where not (coalesce(published_at < (select cutoff from rule), false) and id not in (select content_id from few))", few=FEW, rule=RULE))
def retention_smart(spark, d):
    return M.retention_smart(S.tables(spark, d), AS_OF).select("id", "published_at")


@query(sql("content interactions", """select fresh_today, yesterday_count, total_available, (select count(*) from content where published_at < (select cutoff from rule) and id not in (select content_id from few)) as deleted_count,
 case when fresh_today >= 10 then 'cleanup_performed' when cutoff is not null then 'conservative_cleanup' else 'cleanup_skipped' end as action_taken,
 case when fresh_today >= 10 then 'Fresh content available (' || fresh_today || ' new articles)' when cutoff is not null then 'Limited fresh content (' || fresh_today || ' new), extended retention to 48h'
 else 'Insufficient fresh content (' || fresh_today || ' new articles). Preserving existing content to prevent empty site.' end as reason from rule""", few=FEW, rule=RULE))
def retention_report(spark, d):
    return M.retention_report(S.tables(spark, d), AS_OF)


@query(sql("content interactions", f"select id, published_at from content where not (coalesce(published_at < {NOW} - interval 240 hour, false) and id not in (select content_id from few))", few=FEW))
def retention_days(spark, d):
    return M.retention_days(S.tables(spark, d), AS_OF, 10).select("id", "published_at")


WHOLE_ROWS = "id, source_id, title, summary, article_url, published_at, topic, image_url"


def content_table(spark, d):
    """The content table partitioned by day, and the tables with it in place of the view."""
    path = scratch_path(spark, "content")
    t = S.tables(spark, d)
    dated = t.content.withColumn("published_on", F.to_date("published_at"))
    replace_partitions(dated, path, ["published_on"])
    return path, dated.schema, t.with_(content=spark.read.schema(dated.schema).parquet(path))


@query(sql("content interactions", f"select {WHOLE_ROWS} from content where not (coalesce(published_at < (select cutoff from rule), false) and id not in (select content_id from few))", few=FEW, rule=RULE))
def retention_rewrite(spark, d):
    """The adaptive rule on a partitioned table, in place: partitions that lose no article are not written."""
    path, schema, t = content_table(spark, d)
    M.retention_in_place(t, path, schema, F.lit(M.retention_rule(M.retention_counts(t, AS_OF), AS_OF).first()["cutoff"]).cast("timestamp"))
    return spark.read.schema(schema).parquet(path).select(*WHOLE_ROWS.split(", "))


LEFT = """select 'sources' as name, id as a, null::bigint as b, source_name || ' ' || feed_url as words, null::timestamp as at, null::boolean as flag from sources where id % 3 <> 0
 union all select 'content', id, source_id, concat_ws(' ', title, summary, article_url, topic, image_url), published_at, null from content where source_id % 3 <> 0
 union all select 'interactions', user_id, content_id, null, interaction_at, is_read from interactions where user_id % 5 <> 0 and content_id in (select id from content where source_id % 3 <> 0)
 union all select 'user_topics', user_id, null, topic, null, null from user_topics where user_id % 5 <> 0"""


def left_rows(left):
    """The rows of all tables in one shape."""
    none = {"b": "long", "words": "string", "at": "timestamp", "flag": "boolean"}
    row = lambda df, name, a, **given: df.select(F.lit(name).alias("name"), F.col(a).cast("long").alias("a"), *[
        given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in none.items()])
    words = F.concat_ws(" ", "title", "summary", "article_url", "topic", "image_url")
    return (row(left.sources, "sources", "id", words=F.concat_ws(" ", "source_name", "feed_url"))
            .unionByName(row(left.content, "content", "id", b=F.col("source_id"), words=words, at=F.col("published_at")))
            .unionByName(row(left.interactions, "interactions", "user_id", b=F.col("content_id"), at=F.col("interaction_at"), flag=F.col("is_read")))
            .unionByName(row(left.user_topics, "user_topics", "user_id", words=F.col("topic"))))


@query(sql("content sources interactions user_topics", LEFT))
def cascade_delete(spark, d):
    t = S.tables(spark, d)
    return left_rows(M.cascade_delete(t, source_ids=t.sources.where("id % 3 = 0").select("id"), user_ids=t.users.where("user_id % 5 = 0")))


@query(sql("content sources interactions user_topics", LEFT))
def cascade_rewrite(spark, d):
    """The same, with the articles deleted in place from the table partitioned by day."""
    path, schema, t = content_table(spark, d)
    sources = t.sources.where("id % 3 = 0").select("id")
    delete_rows(spark, path, schema, sources.withColumnRenamed("id", "source_id"), ["source_id"], ["published_on"])
    after = t.with_(content=spark.read.schema(schema).parquet(path))
    return left_rows(M.cascade_delete(after, source_ids=sources, user_ids=t.users.where("user_id % 5 = 0")))


# -- sources ---------------------------------------------------------------------------

REGISTRY = ", ".join(f"('{n}', '{u}')" for n, u in FEEDS)
TARGET = f"""select * from (values {REGISTRY}) t(name, url) union all select 'renamed ' || source_name, feed_url from sources where id % 2 = 0"""


def target(spark, d):
    """Target list: the feed registry and half of the present sources under a new name."""
    from newsweave.sources.feeds import feed_registry

    present = S.sources(spark, d).where("id % 2 = 0").select(F.concat(F.lit("renamed "), "source_name").alias("name"), F.col("feed_url").alias("url"))
    return feed_registry(spark).unionByName(present)


@query(sql("sources", TARGET))
def feed_registry(spark, d):
    return target(spark, d)


@query(sql("sources", """select feed_url, 'remove' as change from sources where feed_url not in (select url from target)
 union all select url, 'add' from target where url not in (select feed_url from sources)""", target=TARGET))
def key_set_difference(spark, d):
    return M.key_set_difference(S.sources(spark, d), target(spark, d).withColumnRenamed("url", "feed_url"), "feed_url")


@query(sql("sources", f"""select id, source_name, feed_url, timestamp '2024-01-01 00:00:00' + interval 1 hour * id as last_fetched_at,
 timestamp '2023-01-01 00:00:00' as created_at, timestamp '2024-01-01 00:00:00' as updated_at from sources where feed_url in (select url from target)
 union all select (select max(id) from sources) + row_number() over (order by url), name, url, null, {NOW}, {NOW} from target where url not in (select feed_url from sources)""", target=TARGET))
def sync_sources(spark, d):
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    present = S.sources(spark, d).withColumns({"last_fetched_at": old + F.make_interval(hours=F.col("id")),
                                               "created_at": F.lit("2023-01-01 00:00:00").cast("timestamp"), "updated_at": old})
    return M.sync_sources(present, target(spark, d), AS_OF)


@query(sql("sources", f"""select id, case when id % 4 = 1 then 'new ' || id else source_name end as source_name,
 case when id % 4 = 2 then 'https://new.example.com/' || id else feed_url end as feed_url,
 case when id % 4 in (1, 2) then {NOW} else timestamp '2024-01-01 00:00:00' end as updated_at from sources"""))
def update_source_partial(spark, d):
    s = S.sources(spark, d)
    i = F.col("id").cast("string")
    patch = s.where("id % 4 <> 0").select("id", F.when(F.expr("id % 4 = 1"), F.concat(F.lit("new "), i)).otherwise(F.lit("")).alias("source_name"),
                                          F.when(F.expr("id % 4 = 2"), F.concat(F.lit("https://new.example.com/"), i)).alias("feed_url"))
    return M.update_source_partial(s.withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp")), patch, AS_OF)


@query(sql("sources", "select id, source_name from sources where id % 3 = 1"))
def active_sources(spark, d):
    flagged = S.sources(spark, d).withColumn("is_active", F.when(F.expr("id % 3 = 1"), True).when(F.expr("id % 3 = 2"), False))
    return M.active_sources(flagged).select("id", "source_name")


@query(sql("sources", "select id, source_name from sources where id % 3 = 2"))
def sources_by_category(spark, d):
    named = S.sources(spark, d).withColumn("category", F.concat(F.lit("c"), F.expr("id % 3").cast("string")))
    return M.sources_by_category(named, "c2").select("id", "source_name")


# -- readers ---------------------------------------------------------------------------

@query(sql("user_topics users", """select user_id, topic from user_topics where user_id % 4 <> 0 union all select user_id, 'Open Source' from users where user_id % 8 = 0"""))
def replace_user_topics(spark, d):
    u = S.users(spark, d)
    return M.replace_user_topics(S.user_topics(spark, d), u.where("user_id % 8 = 0").withColumn("topic", F.lit("Open Source")), u.where("user_id % 8 = 4"))


PREFS = """select user_id, case when user_id % 3 = 0 then null else 'key-points' end as summary_type, 'long' as summary_length,
 timestamp '2024-01-01 00:00:00' as updated_at from users where user_id % 2 = 0"""


def prefs(spark, d):
    return S.users(spark, d).where("user_id % 2 = 0").select(
        "user_id", F.when(F.expr("user_id % 3 <> 0"), "key-points").alias("summary_type"), F.lit("long").alias("summary_length"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))


@query(sql("users", "select u.user_id, coalesce(p.summary_type, 'tldr') as summary_type, coalesce(p.summary_length, 'short') as summary_length from users u left join prefs p using (user_id)", prefs=PREFS))
def preference_defaults(spark, d):
    return M.preference_defaults(S.users(spark, d), prefs(spark, d))


@query(sql("users", f"""select user_id, case when user_id % 5 = 0 then 'tldr' else summary_type end as summary_type,
 case when user_id % 5 = 0 then 'medium' else summary_length end as summary_length, case when user_id % 5 = 0 then {NOW} else updated_at end as updated_at
 from users left join prefs using (user_id) where user_id % 2 = 0 or user_id % 5 = 0""", prefs=PREFS))
def set_preferences(spark, d):
    """Valid patches for every 5th user, half of whom have no row yet; patches with an unknown length for every 7th are refused."""
    u = S.users(spark, d)
    good = u.where("user_id % 5 = 0").select("user_id", F.lit("tldr").alias("summary_type"), F.lit("medium").alias("summary_length"))
    bad = u.where("user_id % 7 = 0").select("user_id", F.lit("tldr").alias("summary_type"), F.lit("huge").alias("summary_length"))
    return M.set_preferences(prefs(spark, d), good.unionByName(bad), AS_OF)


@query(sql("feed_items", "select doc_id, link from feed_items f where doc_id > (select min(doc_id) from feed_items g where g.link = f.link)"))
def unique_violation_report(spark, d):
    return M.unique_violation_report(S.feed_links(spark, d).select("doc_id", "link"), "link", ["doc_id"])


# -- expiring codes --------------------------------------------------------------------

CODES = """select event_id as id, user_id, cast(event_id * 7919 % 1000000 as varchar) as code, ts + interval 48 hour as expires_at, event_type = 'click' as used, ts as created_at from events"""
CODE_COLUMNS = ["id", "user_id", "code", "used", "expires_at"]


def codes(spark, d):
    e = F.col("event_id")
    return S.read(spark, d, "events").select(
        e.alias("id"), "user_id", (e * 7919 % 1000000).cast("string").alias("code"), (F.col("ts") + F.expr("interval 48 hours")).alias("expires_at"),
        (F.col("event_type") == "click").alias("used"), F.col("ts").alias("created_at"))


@query(f"select id, user_id, code, used, expires_at from ({CODES}) where not used and expires_at > {NOW}")
def filter_valid_token(spark, d):
    return M.valid_codes(codes(spark, d), AS_OF).select(*CODE_COLUMNS)


@query(f"""select id, user_id, code, used, expires_at from (select *, row_number() over (partition by user_id order by created_at desc, id desc) as rn from ({CODES}) where not used and expires_at > {NOW}) where rn = 1""")
def latest_valid_per_key(spark, d):
    return M.latest_valid_per_key(codes(spark, d), AS_OF).select(*CODE_COLUMNS)


@query(f"select id, user_id, code, used, expires_at from ({CODES}) c where not used or id = (select min(id) from ({CODES}) b where b.used and b.user_id = c.user_id)")
def keep_first_per_group(spark, d):
    return M.keep_first_per_group(codes(spark, d), ["user_id"], F.col("used")).select(*CODE_COLUMNS)


@query(f"select id, user_id, code, used, expires_at from ({CODES}) where not (used or expires_at < {NOW})")
def ttl_purge(spark, d):
    return M.ttl_purge(codes(spark, d), AS_OF).select(*CODE_COLUMNS)


@query(f"""select c.id, c.user_id, c.code, c.used or (n.newest is not null and c.id <> n.newest) as used, c.expires_at from ({CODES}) c
 left join (select user_id, max(id) as newest from ({CODES}) where created_at >= {NOW} group by user_id) n on n.user_id = c.user_id""")
def invalidate_then_insert(spark, d):
    c, now = codes(spark, d), F.lit(AS_OF).cast("timestamp")
    return M.invalidate_then_insert(c.where(F.col("created_at") < now), c.where(F.col("created_at") >= now)).select(*CODE_COLUMNS)


@query(sql("users", f"""select user_id, case when user_id % 3 = 0 then {NOW} else timestamp '2024-01-01 00:00:00' end as updated_at from users"""))
def touch_updated_at(spark, d):
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return S.users(spark, d).select("user_id", M.touch_updated_at(old, F.expr("user_id % 3 = 0"), AS_OF).alias("updated_at"))


@query(f"select 1 as id, max(ts) as last_ingested_at from events where ts < {NOW} union all select 2, min(ts) from events")
def not_exists_singleton(spark, d):
    """A guarded insert into a table with a row (kept) and into an empty one (inserted)."""
    e = S.read(spark, d, "events")
    now = F.lit(AS_OF).cast("timestamp")
    present = e.where(F.col("ts") < now).agg(F.lit(1).alias("id"), F.max("ts").alias("last_ingested_at"))
    default = e.agg(F.lit(2).alias("id"), F.min("ts").alias("last_ingested_at"))
    return M.ensure_singleton(present, default).unionByName(M.ensure_singleton(present.where("id > 1"), default))


@query("select ts as value from events where event_id = (select event_id from events order by event_id limit 1)")
def scalar_subquery(spark, d):
    return M.first_row_value(S.read(spark, d, "events").select("event_id", F.col("ts").alias("value")), "value", "event_id")
