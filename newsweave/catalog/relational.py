"""Scans, filters, joins, projections, ranking and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.registry import query
from newsweave.catalog.views import AS_OF as NOW
from newsweave.catalog.views import sql
from newsweave.functions import text as X
from newsweave.operators import articles as A
from newsweave.operators import interactions as I
from newsweave.operators import paging as G
from newsweave.operators import ranking as R
from newsweave.operators import state as Z
from newsweave.plans import feeds as P
from newsweave.plans import interests as N
from newsweave.sources import sample as S
from newsweave.sources.sample import AS_OF

NEWEST = "published_at desc nulls first, id"
SIMPLE = ", ".join(A.SIMPLE)
KEYS = "id, topic, published_at"


# -- scans and lookups -----------------------------------------------------------------

@query(sql("articles", f"select {SIMPLE} from articles"))
def scan_articles(spark, d):
    return A.scan_articles(S.tables(spark, d))


@query(sql("articles", f"select {SIMPLE} from articles"), "article_simple")
def _article_simple(spark, d):
    return A.join_source(S.content(spark, d), S.sources(spark, d)).select(*A.SIMPLE)


@query(sql("sources", "select id, source_name, feed_url from sources order by source_name"))
def sources_list(spark, d):
    return S.sources(spark, d).orderBy("source_name")


@query(sql("sources", "select id, source_name, feed_url from sources where id = 7"))
def source_by_id(spark, d):
    return S.sources(spark, d).where("id = 7")


@query(sql("articles", f"select {SIMPLE} from articles where id = 123"))
def article_by_id(spark, d):
    return A.article_by_id(S.tables(spark, d), 123)


def accounts(spark, d):
    """Users with a name and an address made from their id."""
    u = F.col("user_id").cast("string")
    return S.users(spark, d).select("user_id", F.concat(F.lit("user"), u).alias("username"),
                                    F.concat(F.lit("user"), u, F.lit("@mail.example.com")).alias("email"))


@query("""select user_id, concat('user', user_id) as username, concat('user', user_id, '@mail.example.com') as email
 from (select distinct user_id from events) where user_id in (5, 17, 33)""")
def user_lookup(spark, d):
    from newsweave.operators.maintenance import user_lookup as look

    a = accounts(spark, d)
    return (look(a, user_id=5).unionByName(look(a, username="user17")).unionByName(look(a, email="user33@mail.example.com")))


@query(sql("articles", f"select id, source_name, case when source_id % 2 = 0 then 'Featured' else topic end as topic_shown from articles"))
def topic_override(spark, d):
    """Two display forms of the same rows: with and without a custom topic."""
    rows = A.scan_articles(S.tables(spark, d))
    even = rows.where("source_id % 2 = 0").select("id", "source_name", A.topic_shown("Featured").alias("topic_shown"))
    odd = rows.where("source_id % 2 <> 0").select("id", "source_name", A.topic_shown("").alias("topic_shown"))
    return even.unionByName(odd)


# -- projections -----------------------------------------------------------------------

STATE13 = """c.id, c.source_id, c.title, c.summary, c.article_url, c.published_at, c.topic, c.image_url,
 coalesce(i.is_read, false) as is_read, coalesce(i.is_liked, false) as is_liked, coalesce(i.is_liked, false) as is_saved,
 i.interaction_at, c.source_name, c.source_feed_url"""


@query(sql("articles interactions", f"select i.user_id, {STATE13} from interactions i join articles c on c.id = i.content_id"))
def article_with_interactions(spark, d):
    return A.articles_with_interactions(S.tables(spark, d))


@query(sql("articles", """select id, case when summary is null or summary = '' or lower(summary) like 'article url:%'
 or lower(summary) like '<p>article url:%' then 'No summary available for this article.' else summary end as summary_shown,
 case when published_at is null then 'No date' else strftime(published_at, '%Y-%m-%d') end as date_shown from
 (select id, published_at, case id % 4 when 0 then 'Article URL: ' || article_url when 1 then '<p>Article URL: ' || article_url
  when 2 then summary else null end as summary from articles)"""))
def favorites_display(spark, d):
    k, url = F.col("id") % 4, F.col("article_url")
    rows = A.scan_articles(S.tables(spark, d)).withColumn("summary", F.when(k == 0, F.concat(F.lit("Article URL: "), url)).when(
        k == 1, F.concat(F.lit("<p>Article URL: "), url)).when(k == 2, F.col("summary")))
    return A.favorites_display(rows).select("id", "summary_shown", "date_shown")


@query(sql("content", "select id, case when length(summary) > 200 then left(summary, 200) || '...' else summary end as snippet from content"))
def card_snippet(spark, d):
    return S.content(spark, d).select("id", X.card_snippet("summary").alias("snippet"))


# -- filters ---------------------------------------------------------------------------

@query(sql("content interactions", f"""select i.user_id, c.{KEYS.replace(', ', ', c.')} from interactions i join content c on c.id = i.content_id
 where i.is_read is null or i.is_read = false"""))
def filter_unread(spark, d):
    return A.articles_with_interactions(S.tables(spark, d)).where(A.unread()).select("user_id", "id", "topic", "published_at")


@query(sql("content", f"select {KEYS} from content where topic in ('Open Source', 'AI & ML')"))
def filter_topics_any(spark, d):
    c = S.content(spark, d).select("id", "topic", "published_at")
    return c.where(A.in_topics(["Open Source", "AI & ML"])).unionByName(c.where(A.in_topics([])))


@query(sql("content", f"select {KEYS} from content where published_at >= {NOW} - interval 24 hour"))
def filter_last_hours(spark, d):
    return S.content(spark, d).where(A.since_hours(AS_OF, 24)).select("id", "topic", "published_at")


@query(sql("content", f"""select {KEYS}, published_at >= {NOW} - interval 168 hour as rolling from content
 where published_at >= cast(cast({NOW} as date) - 7 as timestamp)"""))
def filter_last_days(spark, d):
    return S.content(spark, d).where(A.since_midnight_days(AS_OF, 7)).select(
        "id", "topic", "published_at", A.since_days(AS_OF, 7).alias("rolling"))


@query(sql("content", f"select {KEYS} from content where published_at >= cast({NOW} as date)"))
def filter_today(spark, d):
    return S.content(spark, d).where(A.since_today(AS_OF)).select("id", "topic", "published_at")


@query(sql("interactions", "select user_id, content_id, interaction_at from interactions where is_liked"))
def filter_liked(spark, d):
    return S.interactions(spark, d).where("is_liked").select("user_id", "content_id", "interaction_at")


@query(sql("content", f"select {KEYS} from content where topic is not null"))
def filter_topic_not_null(spark, d):
    return S.content(spark, d).where(A.has_topic()).select("id", "topic", "published_at")


# -- joins -----------------------------------------------------------------------------

@query(sql("articles", "select id, source_id, source_name, source_feed_url from articles"))
def join_article_source(spark, d):
    return A.join_source(S.content(spark, d).select("id", "source_id"), S.sources(spark, d))


PAGE = f"""select u.user_id, c.{KEYS.replace(', ', ', c.')}, row_number() over (partition by u.user_id order by {NEWEST.replace('id', 'c.id')}) as position
 from content c join user_topics u on u.topic = c.topic"""


def pages(spark, d, interests=None):
    """Every article of each reader's interests, over all dates."""
    return N.articles_of_interests(S.content(spark, d), S.user_topics(spark, d) if interests is None else interests)


def state_table(spark, d):
    return Z.read_state(spark, Z.write_state(S.interactions(spark, d)))


def pages_by_state(spark, d):
    """The state; the rows of ``pages`` that it knows; all others."""
    state = state_table(spark, d)
    return state, *N.split_by_state(S.content(spark, d), S.user_topics(spark, d), state)


@query(sql("content interactions user_topics", """select p.user_id, p.id, coalesce(i.is_read, false) as is_read,
 coalesce(i.is_liked, false) as is_liked, coalesce(i.is_liked, false) as is_saved, i.interaction_at
 from page p left join interactions i on i.content_id = p.id and i.user_id = p.user_id""", page=PAGE))
def join_article_user_state(spark, d):
    state, known, others = pages_by_state(spark, d)
    return A.with_state(known, state).unionByName(A.never_seen(others))


@query(sql("content touches", "select c.id, coalesce(t.n, 0) as interaction_count, coalesce(t.reads, 0) as view_count from content c left join touches t on t.content_id = c.id"))
def join_interaction_fanout(spark, d):
    return A.with_touches(S.content(spark, d).select("id"), S.interactions(spark, d)).select("id", "interaction_count", "view_count")


@query(sql("articles interactions", "select i.user_id, c.id, c.title, c.source_name, i.interaction_at from interactions i join articles c on c.id = i.content_id where i.is_liked"))
def join_liked_inner(spark, d):
    return A.liked_articles(S.tables(spark, d)).select("user_id", "id", "title", "source_name", "interaction_at")


@query(sql("content user_topics", f"select user_id, {KEYS}, position from page", page=PAGE))
def join_user_interests(spark, d):
    doubled = S.user_topics(spark, d).unionByName(S.user_topics(spark, d))
    return pages(spark, d, doubled).select("user_id", "id", "topic", "published_at", F.col("position").cast("long").alias("position"))


@query(sql("content likes", f"select {KEYS} from content where id not in (select content_id from likes)"))
def anti_liked(spark, d):
    return A.without_liked(S.content(spark, d).select("id", "topic", "published_at"), S.interactions(spark, d))


@query(sql("content interactions user_topics", """select user_id, id from page p
 where not exists (select 1 from interactions i where i.user_id = p.user_id and i.content_id = p.id and i.is_read)""", page=PAGE))
def anti_read_by_user(spark, d):
    state, known, others = pages_by_state(spark, d)
    return A.without_read(known, state).unionByName(others)


# -- state -----------------------------------------------------------------------------

@query(sql("interactions", "select user_id, content_id, is_read, is_liked, interaction_at from interactions"))
def fold_interactions(spark, d):
    """The log folded in two halves: the state after the first half is stored in buckets, the second is merged into them."""
    log = S.interaction_log(spark, d)
    half = F.lit("2024-01-16 00:00:00").cast("timestamp")
    before = Z.write_state(I.fold_interactions(None, log.where(F.col("interaction_at") < half)))
    return Z.folded(Z.read_state(spark, before), log.where(F.col("interaction_at") >= half))


@query(sql("interaction_log", """select user_id, content_id, false as is_read, arg_max(liked, row(interaction_at, event_id)) as is_liked,
 max(interaction_at) as interaction_at from (select *, event_id % 3 <> 0 as liked from interaction_log) group by user_id, content_id"""))
def toggle_like(spark, d):
    log = S.interaction_log(spark, d)
    on, off = log.where("event_id % 3 <> 0"), log.where("event_id % 3 = 0")
    return I.fold_interactions(None, I.toggle_like(on, True).unionByName(I.toggle_like(off, False)))


@query(sql("interaction_log", """select user_id, content_id, arg_max(seen, row(interaction_at, event_id)) as is_read, false as is_liked,
 max(interaction_at) as interaction_at from (select *, event_id % 4 <> 0 as seen from interaction_log) group by user_id, content_id"""))
def mark_read(spark, d):
    log = S.interaction_log(spark, d)
    on, off = log.where("event_id % 4 <> 0"), log.where("event_id % 4 = 0")
    return I.fold_interactions(None, I.mark_read(on, True).unionByName(I.mark_read(off, False)))


# -- paging and ranking ----------------------------------------------------------------

@query(sql("content", f"select {KEYS} from content order by {NEWEST} limit 50 offset 30"))
def latest_page(spark, d):
    return R.page(S.content(spark, d).select("id", "topic", "published_at"), A.newest_first(), 50, 30)


@query(sql("content", f"select {KEYS} from content order by {NEWEST} limit 45 offset 105"))
def deep_page(spark, d):
    """Rows far down: two pages from the partitions in which they lie, and one by the key of the last row before it."""
    keys = S.content(spark, d).select("id", "topic", "published_at")
    index = G.page_index(keys, 40)
    second = index.page(15, 120)
    last = second.orderBy(*A.newest_first()).tail(1)[0]
    return index.page(15, 105).unionByName(second).unionByName(G.seek_page(keys, 15, (last["published_at"], last["id"])))


@query(sql("articles", f"select {SIMPLE} from articles order by {NEWEST} limit 20 offset 140"))
def general_digest_deep(spark, d):
    t = S.tables(spark, d)
    return P.general_digest(t, 20, 140, P.digest_index(t, 50))


@query(sql("content", f"select {KEYS} from content order by {NEWEST} limit 50"))
def shuffle_page(spark, d):
    first = R.page(S.content(spark, d).select("id", "topic", "published_at"), A.newest_first(), 50)
    return R.shuffle_page(first, F.col("id"), 7)


@query(sql("articles interactions", """select i.user_id, row_number() over (partition by i.user_id order by i.interaction_at desc nulls first, c.id) as position, c.id, c.title, c.topic,
 i.is_read, i.interaction_at from interactions i join articles c on c.id = i.content_id where i.is_liked"""))
def favorites(spark, d):
    return A.favorites(S.tables(spark, d)).select("user_id", "position", "id", "title", "topic", "is_read", "interaction_at")


@query(sql("content", f"select {KEYS}, row_number() over (partition by topic order by {NEWEST}) as position from content"))
def position_in_topic(spark, d):
    """Exact position of every article in its topic, by the distributed sort."""
    return R.position_in_group(S.content(spark, d).select("id", "topic", "published_at"), ["topic"], A.newest_first(), "position").withColumn(
        "position", F.col("position").cast("long"))


# -- feeds -----------------------------------------------------------------------------

FULL = """row_number() over (partition by {u}.user_id order by c.published_at desc nulls first, c.id)"""
SHOWN = "user_id, position, id, title, topic, published_at, is_read, is_liked, source_name"
SHOWN_COLUMNS = SHOWN.split(", ")


@query(sql("articles", f"select {SIMPLE} from articles order by {NEWEST} limit 20"))
def general_digest(spark, d):
    return P.general_digest(S.tables(spark, d))


UNREAD = """select u.user_id, c.*, coalesce(i.is_read, false) as is_read, coalesce(i.is_liked, false) as is_liked,
 row_number() over (partition by u.user_id order by c.published_at desc nulls first, c.id) as rn
 from users u cross join articles c left join interactions i on i.user_id = u.user_id and i.content_id = c.id
 where i.is_read is null or i.is_read = false"""


@query(sql("users articles interactions", f"select {SHOWN.replace('position', 'rn as position')} from unread where rn <= 20", unread=UNREAD))
def personalized_digest(spark, d):
    return P.personalized_digest(S.tables(spark, d)).withColumn("position", F.col("position").cast("long")).select(*SHOWN_COLUMNS)


@query(sql("users articles interactions", f"select {SHOWN.replace('position', 'rn - 20 as position')} from every where rn > 20 and rn <= 30",
           every=UNREAD.replace("where i.is_read is null or i.is_read = false", "")))
def personalized_digest_with_read(spark, d):
    return P.personalized_digest(S.tables(spark, d), limit=10, offset=20, include_read=True).withColumn(
        "position", F.col("position").cast("long")).select(*SHOWN_COLUMNS)


TOPICAL = """select u.user_id, c.*, coalesce(i.is_read, false) as is_read, coalesce(i.is_liked, false) as is_liked,
 row_number() over (partition by u.user_id order by c.published_at desc nulls first, c.id) as rn
 from user_topics u join articles c on c.topic = u.topic left join interactions i on i.user_id = u.user_id and i.content_id = c.id
 where c.published_at >= {now} - interval {hours} hour"""


@query(sql("user_topics articles interactions", f"select {SHOWN.replace('position', 'rn as position')} from feed where rn <= 100",
           feed=TOPICAL.format(now=NOW, hours=24)))
def topic_feed_24h(spark, d):
    return P.topic_feed(S.tables(spark, d), AS_OF, 24).withColumn("position", F.col("position").cast("long")).select(*SHOWN_COLUMNS)


@query(sql("user_topics articles interactions", f"select {SHOWN.replace('position', 'rn - 5 as position')} from feed where rn > 5 and rn <= 105",
           feed=TOPICAL.format(now=NOW, hours=168)))
def topic_feed_7d(spark, d):
    return P.topic_feed(S.tables(spark, d), AS_OF, 168, offset=5).withColumn("position", F.col("position").cast("long")).select(*SHOWN_COLUMNS)


@query(sql("user_topics users articles interactions", """
 select user_id, 'interests' as slot, rn as position, id from mine
 union all select u.user_id, case when w.user_id is null then 'general' else 'fallback' end, u.rn, u.id
 from unread u left join (select distinct user_id from user_topics) w on w.user_id = u.user_id
 where u.user_id not in (select user_id from mine) and u.rn <= case when w.user_id is null then 30 else 10 end""",
           feed=TOPICAL.format(now=NOW, hours=168), mine="select * from feed where rn <= 30 and not is_read", unread=UNREAD))
def fast_view(spark, d):
    return P.fast_view(S.tables(spark, d), AS_OF).select("user_id", "slot", F.col("position").cast("long").alias("position"), "id")


@query(sql("user_topics users articles interactions", """
 select user_id, position, total_unread, id, published_at from (
  select user_id, id, published_at, row_number() over (partition by user_id order by rn) as position, count(*) over (partition by user_id) as total_unread
  from feed where not is_read
  union all select user_id, id, published_at, rn, count(*) over (partition by user_id)
  from unread where user_id not in (select user_id from user_topics)) where position <= 20""",
           feed=TOPICAL.format(now=NOW, hours=168), unread=UNREAD))
def fast_batch(spark, d):
    return P.fast_batch(S.tables(spark, d), AS_OF).select(
        "user_id", F.col("position").cast("long").alias("position"), "total_unread", "id", "published_at")


POOL = f"select * from articles order by {NEWEST} limit 80"
SECTIONS = f"""select t.topic as section, p.rn as position, p.id, p.title, p.published_at, p.source_name from topic_dim t left join
 (select *, row_number() over (partition by topic order by {NEWEST}) as rn from pool) p on p.topic = t.topic and p.rn <= 25"""
RECOMMENDED = f"""select * from (select u.user_id, p.id, p.title, p.published_at, p.source_name,
 row_number() over (partition by u.user_id order by {NEWEST}) as position from pool p join user_topics u on u.topic = p.topic) where position <= 25"""


@query(sql("articles topic_dim", SECTIONS, pool=POOL))
def topn_per_topic(spark, d):
    return P.topn_per_topic(S.tables(spark, d), per_topic=25).select(
        "section", F.col("position").cast("long").alias("position"), "id", "title", "published_at", "source_name")


@query(sql("articles user_topics", f"select user_id, position, id, title, published_at, source_name from ({RECOMMENDED})", pool=POOL))
def recommended_section(spark, d):
    return P.recommended_section(S.tables(spark, d), per_topic=25).select(
        "user_id", F.col("position").cast("long").alias("position"), "id", "title", "published_at", "source_name")


@query(sql("articles user_topics topic_dim", f"""select section, cast(null as bigint) as user_id, position, id, title, published_at, source_name from ({SECTIONS})
 union all select 'Recommended For You', user_id, position, id, title, published_at, source_name from ({RECOMMENDED})""", pool=POOL))
def home_sections(spark, d):
    return P.home_sections(S.tables(spark, d), per_topic=25).withColumn("position", F.col("position").cast("long"))


USER_TOP = f"""select * from (select u.user_id, c.id, c.title, c.summary, c.topic, c.article_url as url,
 row_number() over (partition by u.user_id order by c.published_at desc, c.id) as position
 from content c join user_topics u on u.topic = c.topic where c.published_at >= cast({NOW} as date)
 and not exists (select 1 from interactions i where i.user_id = u.user_id and i.content_id = c.id and i.is_read)) where position <= 5"""


@query(sql("content user_topics interactions", USER_TOP))
def user_top_articles(spark, d):
    return P.user_top_articles(S.tables(spark, d), AS_OF).withColumn("position", F.col("position").cast("long"))


@query(sql("content user_topics interactions", f"""select p.user_id, cast({NOW} as date) as date, 'Top stories today: ' || parts || '.' as summary, article_ids
 from (select user_id, string_agg(n || case when n > 1 then ' articles in ' else ' article in ' end || topic, ', ' order by r) as parts
  from (select user_id, topic, count(*) as n, min(position) as r from top group by user_id, topic) group by user_id) p
 join (select user_id, to_json(list(id order by position)) as article_ids from top group by user_id) a using (user_id)""", top=USER_TOP))
def daily_digest_table(spark, d):
    return P.daily_digest_table(S.tables(spark, d), AS_OF).withColumn("article_ids", F.to_json("article_ids"))
