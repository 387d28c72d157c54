"""Topic, company and article trends; reading statistics.

Interactions are always counted by article first. ``id`` is the article key, so a count
of articles after that join is a plain count: no distinct aggregate, no fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import clock
from newsweave.functions.text import clean_article_text, let
from newsweave.operators import articles as A
from newsweave.operators.partials import by_article
from newsweave.operators.ranking import page
from newsweave.sources.tables import Tables

#: Company -> title aliases.
COMPANIES = {
    "Twitter/X": ["Twitter", "X"],
    "OpenAI": ["OpenAI"],
    "Google": ["Google"],
    "Microsoft": ["Microsoft"],
    "Apple": ["Apple"],
    "Amazon": ["Amazon"],
    "Meta": ["Meta", "Facebook"],
    "Tesla": ["Tesla"],
    "NVIDIA": ["NVIDIA"],
    "AMD": ["AMD"],
    "Intel": ["Intel"],
    "Samsung": ["Samsung"],
    "Anthropic": ["Anthropic"],
    "SpaceX": ["SpaceX"],
    "Netflix": ["Netflix"],
    "Adobe": ["Adobe"],
    "Oracle": ["Oracle"],
    "IBM": ["IBM"],
    "Salesforce": ["Salesforce"],
    "TikTok": ["TikTok"],
    "ByteDance": ["ByteDance"],
    "Alibaba": ["Alibaba"],
    "Tencent": ["Tencent"],
    "Uber": ["Uber"],
    "Lyft": ["Lyft"],
    "Airbnb": ["Airbnb"],
    "Spotify": ["Spotify"],
    "GitHub": ["GitHub"],
    "GitLab": ["GitLab"],
    "Docker": ["Docker"],
    "Kubernetes": ["Kubernetes"],
    "AWS": ["AWS"],
    "Azure": ["Azure"],
    "GCP": ["GCP"],
}


def topic_trends_daily(t: Tables, date=None) -> DataFrame:
    """(date, topic): articles, reads and interactions of the articles published that day."""
    dated = t.content.where(F.col("published_at").isNotNull() & A.has_topic())
    if date is not None:
        dated = dated.where(A.on_date(date))
    touched = A.with_touches(dated.select("id", "topic", "published_at"), t.interactions)
    return touched.groupBy(F.to_date("published_at").alias("date"), "topic").agg(
        F.count("*").alias("article_count"), F.sum("view_count").alias("view_count"),
        F.sum("interaction_count").alias("interaction_count"))


def topic_trends_window(trends: DataFrame, as_of, days: int = 7) -> DataFrame:
    return (trends.where(F.col("date") >= F.date_sub(clock.day(as_of), days))
            .orderBy(F.col("date").desc(), F.col("article_count").desc(), "topic"))


def upsert_topic_trends(trends: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored trends with every (date, topic) of ``fresh`` replaced."""
    kept = trends.join(fresh.select("date", "topic"), ["date", "topic"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def trending_topics(t: Tables, as_of, hours: int = 24, limit: int = 5) -> DataFrame:
    recent = t.content.where(A.since_hours(as_of, hours) & A.has_topic())
    return page(recent.groupBy("topic").agg(F.count("*").alias("article_count")),
                [F.col("article_count").desc(), F.col("topic")], limit)


def topic_distribution(t: Tables) -> DataFrame:
    return (t.content.where(A.has_topic()).groupBy("topic").agg(F.count("*").alias("article_count"))
            .orderBy(F.col("article_count").desc(), "topic"))


def ingestion_stats(t: Tables, as_of, days: int = 7) -> DataFrame:
    """Daily article counts and, in the same pass, their total (``is_total``)."""
    recent = t.content.where(A.since_midnight_days(as_of, days)).select(F.to_date("published_at").alias("date"))
    return (recent.rollup("date")
            .agg(F.count("*").alias("article_count"), (F.grouping("date") == 1).alias("is_total"))
            .orderBy("is_total", F.col("date").desc()))


def user_reading_stats(t: Tables, as_of, user_id: int | None = None, days: int = 30) -> DataFrame:
    """Articles read, active days and last read per user; zero row for users without reads.

    State has one row per (user, article), so the distinct article count is a row count.
    Counting by (user, day) first keeps a very active reader out of one task.
    """
    from newsweave.sources.tables import distinct_users, one_user

    reads = one_user(t.interactions, user_id).where(
        F.col("is_read") & (F.col("interaction_at") >= clock.midnight_days_before(as_of, days)))
    daily = reads.groupBy("user_id", F.to_date("interaction_at").alias("_day")).agg(
        F.count("*").alias("_n"), F.max("interaction_at").alias("_last"))
    stats = daily.groupBy("user_id").agg(
        F.sum("_n").alias("articles_read"), F.count("*").alias("active_days"), F.max("_last").alias("last_read"))
    return (one_user(distinct_users(t), user_id).join(stats, "user_id", "left")
            .select("user_id", F.coalesce("articles_read", F.lit(0)).alias("articles_read"),
                    F.coalesce("active_days", F.lit(0)).alias("active_days"), "last_read"))


def recent_counts(t: Tables, as_of, hours: int = 24, partials: DataFrame | None = None) -> DataFrame:
    """(id, topic, title, published_at, interaction_count, view_count) of the articles of the last ``hours``: what all trends of that window
    are added up from. ``partials`` is a table of hourly counts (``operators.partials``), with which the state is not read."""
    recent = t.content.where(A.since_hours(as_of, hours)).select("id", "topic", "title", "published_at")
    if partials is None:
        return A.with_touches(recent, t.interactions)
    counted = by_article(partials, clock.hours_before(as_of, hours)).select(F.col("id").alias("_id"), "interaction_count", "view_count")
    return recent.join(counted, F.col("id") == F.col("_id"), "left").drop("_id").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("interaction_count", "view_count")})


def trending_topics_counts(t: Tables, as_of, hours: int = 24, limit: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """``counts``: ``recent_counts`` of the same hours, where they are known already."""
    if counts is None:
        counts = A.with_touches(t.content.where(A.since_hours(as_of, hours) & A.has_topic()).select("id", "topic"), t.interactions)
    counted = (counts.where(A.has_topic()).groupBy("topic")
               .agg(F.count("*").alias("article_count"), F.sum("interaction_count").alias("interaction_count")))
    return page(counted, [F.col("interaction_count").desc(), F.col("article_count").desc(), F.col("topic")], limit)


def company_mentions(title: Column, aliases: dict[str, list[str]] | None = None, match: str = "substring") -> Column:
    """Array of the companies named in ``title``, each once. ``match="word"`` asks for whole
    words instead of plain substrings of the upper-cased title."""
    rows = F.array(*[F.struct(F.lit(c).alias("company"), F.array(*[F.lit(a.upper()) for a in names]).alias("aliases"))
                     for c, names in (aliases or COMPANIES).items()])
    if match == "substring":
        hit = lambda text, alias: F.contains(text, alias)
    elif match == "word":
        edge = r"[\p{L}\p{N}_]"
        hit = lambda text, alias: F.regexp_like(
            text, F.concat(F.lit(f"(?<!{edge})\\Q"), alias, F.lit(f"\\E(?!{edge})")))
    else:
        raise ValueError(f"match must be 'substring' or 'word', not {match!r}")
    upper = F.array(F.upper(title))
    return F.transform(upper, lambda text: F.transform(
        F.filter(rows, lambda row: F.exists(row["aliases"], lambda alias: hit(text, alias))),
        lambda row: row["company"]))[0]


def trending_companies(t: Tables, as_of, aliases=None, hours: int = 24, limit: int = 10, match: str = "substring",
                       counts: DataFrame | None = None) -> DataFrame:
    named = company_mentions(F.col("title"), aliases, match).alias("companies")
    if counts is None:
        recent = t.content.where(A.since_hours(as_of, hours)).select("id", "title")
        counted = A.with_touches(recent.select("id", named).where(F.size("companies") > 0), t.interactions)
    else:
        counted = counts.select(named, "interaction_count")
    scored = counted.select(F.explode("companies").alias("company"), "interaction_count")
    totals = scored.groupBy("company").agg(F.count("*").alias("mentions"), F.sum("interaction_count").alias("interaction_score"))
    return page(totals, [F.col("interaction_score").desc(), F.col("mentions").desc(), F.col("company")], limit)


def share_of_total(counts: DataFrame, count: str = "article_count") -> DataFrame:
    """Adds ``percentage`` of the total, which is one number: the groups themselves never meet in one task."""
    total = counts.agg(F.sum(count).alias("_total")).scalar()
    return counts.withColumn("_total", total).withColumn(
        "percentage", F.expr(f"((2000 * {count} + _total) div (2 * _total)) / 10.0D")).drop("_total")


def topic_share(t: Tables, as_of, days: int = 7) -> DataFrame:
    recent = t.content.where(A.since_midnight_days(as_of, days) & A.has_topic())
    counts = recent.groupBy("topic").agg(F.count("*").alias("article_count"))
    return share_of_total(counts).orderBy(F.col("article_count").desc(), "topic")


def trending_articles(t: Tables, as_of, hours: int = 24, limit: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """Most touched recent articles. Only ids are ranked; the long summary is fetched and
    cleaned for the ``limit`` winners."""
    recent = t.content.where(A.since_hours(as_of, hours) & A.has_topic())
    if counts is None:
        counts = A.with_touches(recent.select("id", "topic", "published_at"), t.interactions)
    ranked = page(counts.where(A.has_topic()), [F.col("interaction_count").desc()] + A.newest_first(), limit)
    best = ranked.select(F.col("id").alias("_id"), F.col("interaction_count").alias("interactions"))
    return (recent.join(best, F.col("id") == F.col("_id"))
            .orderBy(F.col("interactions").desc(), *A.newest_first())
            .select("id", "title", clean_article_text("summary").alias("summary"), "topic",
                    F.col("article_url").alias("url"), "image_url", "interactions", "published_at"))


def briefing_sentence(topics: Column) -> Column:
    """Sentence for an array of article topics: counts per topic, in order of first appearance."""
    part = lambda n, topic: F.concat(n.cast("string"), F.when(n > 1, F.lit(" articles in ")).otherwise(F.lit(" article in ")), topic)

    def sentence(listed):
        parts = F.transform(F.array_distinct(listed), lambda topic: part(F.size(F.filter(listed, lambda x: x == topic)), topic))
        return F.when(F.size(listed) == 0, F.lit("No trending articles today.")).otherwise(
            F.concat(F.lit("Top stories today: "), F.array_join(parts, ", "), F.lit(".")))

    return let(F.transform(topics, lambda t: F.coalesce(t, F.lit("Tech News"))), sentence)


def briefing_text(trending: DataFrame, top: int = 5) -> DataFrame:
    """One row, one sentence: how many of the first ``top`` trending articles each topic has."""
    first = page(trending, [F.col("interactions").desc()] + A.newest_first(), top)
    listed = F.sort_array(F.collect_list(F.struct(
        F.col("interactions").alias("i"), F.col("published_at").alias("p"), (-F.col("id")).alias("n"), "topic")), asc=False)
    return (first.agg(listed.alias("_l"))
            .select(briefing_sentence(F.transform("_l", lambda row: row["topic"])).alias("briefing")))


def content_stats(t: Tables, as_of) -> DataFrame:
    """Totals for job monitoring, one row, one pass."""
    at = F.col("published_at")
    return t.content.agg(
        F.count("*").alias("total_articles"),
        F.count_if(at >= clock.hours_before(as_of, 24)).alias("articles_last_24h"),
        F.count_if(at >= clock.days_before(as_of, 7)).alias("articles_last_week"),
        F.max(at).alias("most_recent_article"))


def content_top_topics(t: Tables, top: int = 5) -> DataFrame:
    """Largest topics of all time; articles without a topic are a group of their own."""
    return page(t.content.groupBy("topic").agg(F.count("*").alias("article_count")),
                [F.col("article_count").desc(), F.col("topic").asc_nulls_first()], top)


def classification_method_mix(classified: DataFrame) -> DataFrame:
    return classified.groupBy("method").agg(F.count("*").alias("article_count"))


def borderline_articles(scored: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Rows with a score, nearest to the decision threshold first."""
    return scored.where(F.col("ai_confidence_score").isNotNull()).orderBy(
        F.abs(F.col("ai_confidence_score") - F.lit(threshold)), "id")


def source_stats(t: Tables, as_of) -> DataFrame:
    """Articles in total and today, and the latest article, for every source."""
    counts = t.content.groupBy("source_id").agg(
        F.count("*").alias("n"), F.count_if(A.on_date(clock.day(as_of))).alias("today"),
        F.max("published_at").alias("last_fetch"))
    return (t.sources.join(counts, F.col("id") == F.col("source_id"), "left")
            .select("id", "source_name", F.coalesce("n", F.lit(0)).alias("total_articles"),
                    F.coalesce("today", F.lit(0)).alias("articles_today"), "last_fetch"))


def user_stats(t: Tables) -> DataFrame:
    """Reads, likes and last activity per user."""
    return t.interactions.groupBy("user_id").agg(
        F.count_if("is_read").alias("articles_read"), F.count_if("is_liked").alias("articles_liked"),
        F.max("interaction_at").alias("last_activity"))
