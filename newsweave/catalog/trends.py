"""Aggregates and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave import clock
from newsweave.catalog.registry import ORACLE, query
from newsweave.catalog.views import AS_OF as NOW
from newsweave.catalog.views import sql
from newsweave.operators import partials as W
from newsweave.operators import trends as T
from newsweave.operators.interactions import fold_interactions
from newsweave.plans import dashboard as D
from newsweave.session import cut_lineage, scratch_path
from newsweave.sources import sample as S
from newsweave.sources.sample import AS_OF

TRENDS_DAILY = """select cast(c.published_at as date) as date, c.topic, count(distinct c.id) as article_count,
 cast(sum(case when i.is_read then 1 else 0 end) as bigint) as view_count, count(i.user_id) as interaction_count
 from content c left join interactions i on i.content_id = c.id
 where c.published_at is not null and c.topic is not null group by 1, 2"""


@query(sql("content interactions", TRENDS_DAILY))
def topic_trends_daily(spark, d):
    return T.topic_trends_daily(S.tables(spark, d))


def hourly_counts(spark, d):
    """Table of hourly counts from two batches: the articles with the commands of the first days, then the rest of the commands."""
    t, log = S.tables(spark, d), S.interaction_log(spark, d)
    path, half = scratch_path(spark, "counts"), F.lit("2024-01-16 00:00:00").cast("timestamp")
    before = cut_lineage(fold_interactions(None, log.where(F.col("interaction_at") < half)))
    late = log.where(F.col("interaction_at") >= half)
    touched = before.join(late.select("user_id", "content_id").distinct(), ["user_id", "content_id"], "left_semi")
    W.write_batch(W.article_rows(t.content).unionByName(W.state_rows(before, t.content)), path, 0)
    W.write_batch(W.state_rows(fold_interactions(touched, late), t.content, touched), path, 1)
    return W.read_counts(spark, path)


@query(sql("content interactions", TRENDS_DAILY))
def topic_trends_partials(spark, d):
    """The daily trends, added up from the hourly counts of two batches."""
    return W.daily_trends(hourly_counts(spark, d))


@query(sql("content interactions", TRENDS_DAILY.replace("where ", "where cast(c.published_at as date) = date '2024-01-15' and ")))
def filter_on_date(spark, d):
    return T.topic_trends_daily(S.tables(spark, d), "2024-01-15")


@query(sql("content interactions", f"select * from ({TRENDS_DAILY}) where date >= cast({NOW} as date) - 7"))
def topic_trends_window(spark, d):
    """The window cut from the hourly counts before they are added up."""
    return T.topic_trends_window(W.daily_trends(hourly_counts(spark, d), F.date_sub(clock.day(AS_OF), 7)), AS_OF)


@query(sql("content interactions", """select date, topic, article_count,
 case when date = date '2024-01-15' then view_count else 0 end as view_count, interaction_count from trends
 where date <= date '2024-01-15'""", trends=TRENDS_DAILY))
def upsert_topic_trends(spark, d):
    """Stored trends up to the 15th with outdated view counts; the 15th is computed anew."""
    t = S.tables(spark, d)
    stored = T.topic_trends_daily(t).where("date <= date'2024-01-15'").withColumn("view_count", F.lit(0).cast("long"))
    return T.upsert_topic_trends(stored, T.topic_trends_daily(t, "2024-01-15"))


@query(sql("content", f"""select topic, count(*) as article_count from content
 where published_at >= {NOW} - interval 24 hour and topic is not null group by topic order by 2 desc, 1 limit 5"""))
def trending_topics(spark, d):
    return T.trending_topics(S.tables(spark, d), AS_OF)


@query(sql("content", "select topic, count(*) as article_count from content where topic is not null group by topic"))
def topic_distribution(spark, d):
    return T.topic_distribution(S.tables(spark, d))


DAILY = f"select * from content where published_at >= cast(cast({NOW} as date) - 7 as timestamp)"


@query(sql("content", f"select cast(published_at as date) as date, count(*) as article_count, false as is_total from ({DAILY}) group by 1 "
           f"union all select null, count(*), true from ({DAILY})"))
def ingestion_daily(spark, d):
    return T.ingestion_stats(S.tables(spark, d), AS_OF)


@query(sql("content", f"select count(*) as total from ({DAILY})"))
def ingestion_total(spark, d):
    return T.ingestion_stats(S.tables(spark, d), AS_OF).where("is_total").select(F.col("article_count").alias("total"))


@query(sql("interactions users", f"""select u.user_id, count(distinct i.content_id) as articles_read,
 count(distinct cast(i.interaction_at as date)) as active_days, max(i.interaction_at) as last_read
 from users u left join interactions i on i.user_id = u.user_id and i.is_read
  and i.interaction_at >= cast(cast({NOW} as date) - 30 as timestamp) group by u.user_id"""))
def user_reading_stats(spark, d):
    return T.user_reading_stats(S.tables(spark, d), AS_OF)


@query(sql("content interactions", f"""select c.topic, count(distinct c.id) as article_count, count(i.user_id) as interaction_count
 from content c left join interactions i on i.content_id = c.id
 where c.published_at >= {NOW} - interval 24 hour and c.topic is not null group by c.topic order by 3 desc, 2 desc, 1 limit 10"""))
def trending_topics_counts(spark, d):
    return T.trending_topics_counts(S.tables(spark, d), AS_OF)


ALIASES = ", ".join(f"('{c}','{a.upper()}')" for c, names in T.COMPANIES.items() for a in names)
COMPANY_ROWS = f"""select c.id, a.company, coalesce(t.n, 0) as n
 from content c join (values {ALIASES}) a(company, alias) on contains(upper(c.title), a.alias)
 left join touches t on t.content_id = c.id where c.published_at >= {NOW} - interval 24 hour group by c.id, a.company, t.n"""
COMPANY_TOP = """select company, count(*) as mentions, cast(sum(n) as bigint) as interaction_score from hits
 group by company order by 3 desc, 2 desc, 1 limit 10"""


@query(sql("content touches", COMPANY_TOP, hits=COMPANY_ROWS))
def trending_companies(spark, d):
    return T.trending_companies(S.tables(spark, d), AS_OF)


SHARE = f"""select topic, article_count, ((2000 * article_count + total) // (2 * total)) / 10.0 as percentage from
 (select topic, count(*) as article_count, cast(sum(count(*)) over () as bigint) as total from content
  where published_at >= cast(cast({NOW} as date) - 7 as timestamp) and topic is not null group by topic)"""


@query(sql("content", SHARE))
def topic_distribution_7day(spark, d):
    return T.topic_share(S.tables(spark, d), AS_OF)


@query(sql("interactions", """select content_id, n as interactions,
 ((2000 * n + total) // (2 * total)) / 10.0 as percentage from (select content_id % 10 as content_id, count(*) as n,
 cast(sum(count(*)) over () as bigint) as total from interactions group by 1)"""))
def share_of_total(spark, d):
    counts = S.interactions(spark, d).groupBy((F.col("content_id") % 10).alias("content_id")).agg(F.count("*").alias("interactions"))
    return T.share_of_total(counts, "interactions")


WSP = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def clean_sql(c: str) -> str:
    """Cleaned summary text in DuckDB SQL."""
    s = f"regexp_replace({c}, 'https?://[^,{WSP[1:-1]}]+', '', 'g')"
    for label in ("Comments URL:", "URL:", "Source:", "See also:"):
        s = f"regexp_replace({s}, '{label}{WSP}*', '', 'g')"
    s = f"regexp_replace({s}, '{WSP}*,{WSP}*,{WSP}*', ', ', 'g')"
    s = rf"regexp_replace({s}, '\A,{WSP}*', '')"
    s = rf"regexp_replace({s}, '{WSP}*,\n?\z', '')"
    s = f"trim(regexp_replace({s}, '{WSP}+', ' ', 'g'))"
    return (f"case when coalesce({c}, '') = '' then 'No summary available.' "
            rf"when length({s}) < 20 or not regexp_matches({s}, '[\p{{L}}\p{{N}}_]') then 'Article summary not available.' else {s} end")


def top_articles_sql(k: int) -> str:
    return f"""select c.id, c.title, {clean_sql('c.summary')} as summary, c.topic, c.article_url as url, c.image_url,
 coalesce(t.n, 0) as interactions, c.published_at from content c left join touches t on t.content_id = c.id
 where c.published_at >= {NOW} - interval 24 hour and c.topic is not null
 order by interactions desc, c.published_at desc, c.id limit {k}"""


@query(sql("content touches", top_articles_sql(50)))
def trending_articles(spark, d):
    return T.trending_articles(S.tables(spark, d), AS_OF, limit=50)


BRIEFING = """select case when count(*) = 0 then 'No trending articles today.' else 'Top stories today: ' ||
 string_agg(part, ', ' order by r) || '.' end as briefing from (select min(r) as r,
 count(*) || case when count(*) > 1 then ' articles in ' else ' article in ' end || coalesce(topic, 'Tech News') as part
 from (select topic, row_number() over (order by interactions desc, published_at desc, id) as r from top) where r <= 5 group by topic)"""


@query(sql("content touches", BRIEFING, top=top_articles_sql(5)))
def briefing_text(spark, d):
    return T.briefing_text(T.trending_articles(S.tables(spark, d), AS_OF))


STATS = f"""select count(*) as total_articles, count(*) filter (where published_at >= {NOW} - interval 24 hour) as articles_last_24h,
 count(*) filter (where published_at >= {NOW} - interval 168 hour) as articles_last_week, max(published_at) as most_recent_article"""


@query(sql("content", f"{STATS} from content"))
def content_stats(spark, d):
    return T.content_stats(S.tables(spark, d), AS_OF)


@query(sql("content", "select topic, count(*) as article_count from content group by topic order by 2 desc, 1 nulls first limit 5"))
def topk_groups(spark, d):
    return T.content_top_topics(S.tables(spark, d))


@query(sql("content", f"""{STATS}, (select list(concat_ws(':', topic, n) order by n desc, topic nulls first) from
 (select topic, count(*) as n from content group by topic order by n desc, topic nulls first limit 5)) as top_topics,
 true as success, {NOW} as timestamp, 'Job status retrieved successfully' as message from content"""))
def job_status(spark, d):
    return D.job_status(S.tables(spark, d), AS_OF).withColumn("top_topics", F.transform("top_topics", lambda r: F.concat_ws(":", r["topic"], r["count"].cast("string"))))


@query(sql("content sources", f"""select s.id, s.source_name, count(c.id) as total_articles,
 count(*) filter (where cast(c.published_at as date) = cast({NOW} as date)) as articles_today, max(c.published_at) as last_fetch
 from sources s left join content c on c.source_id = s.id group by s.id, s.source_name"""))
def source_stats(spark, d):
    return T.source_stats(S.tables(spark, d), AS_OF)


@query(sql("interactions", """select user_id, count(*) filter (where is_read) as articles_read,
 count(*) filter (where is_liked) as articles_liked, max(interaction_at) as last_activity from interactions group by user_id"""))
def user_stats(spark, d):
    return T.user_stats(S.tables(spark, d))


@query(sql("content touches interactions", f"""
 select 'trending_topics' as part, topic as label, cast(article_count as double) as count, cast(interaction_count as double) as score from
  (select c.topic, count(distinct c.id) as article_count, count(i.user_id) as interaction_count
   from content c left join interactions i on i.content_id = c.id
   where c.published_at >= {NOW} - interval 24 hour and c.topic is not null group by c.topic order by 3 desc, 2 desc, 1 limit 10)
 union all select 'trending_companies', company, mentions, interaction_score from ({COMPANY_TOP})
 union all select 'topic_share', topic, article_count, percentage from ({SHARE})
 union all select 'trending_articles', title, id, interactions from top
 union all select 'briefing', briefing, null, null from ({BRIEFING})""",
           hits=COMPANY_ROWS, top=top_articles_sql(6)))
def dashboard(spark, d):
    return D.dashboard_rows(S.tables(spark, d), AS_OF)


@query(ORACLE["dashboard"])
def dashboard_partials(spark, d):
    """The dashboard from the table of hourly counts: the state is not read."""
    return D.dashboard_rows(S.tables(spark, d), AS_OF, hourly_counts(spark, d))
