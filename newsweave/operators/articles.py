"""Article projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import clock
from newsweave.operators.interactions import liked_ids, per_article
from newsweave.operators.ranking import position_in_group
from newsweave.sources.tables import Tables, one_user

BASE = ["id", "source_id", "title", "summary", "article_url", "published_at", "topic", "image_url"]
SIMPLE = BASE + ["source_name", "source_feed_url"]
WITH_STATE = BASE + ["is_read", "is_liked", "is_saved", "interaction_at", "source_name", "source_feed_url"]


def newest_first() -> list[Column]:
    """Undated articles lead, then newest; ``id`` settles ties."""
    return [F.col("published_at").desc_nulls_first(), F.col("id").asc()]


# -- joins -----------------------------------------------------------------------------

def join_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with their source; inner, so an orphan disappears. The source side is
    left to the size-checked broadcast of the planner."""
    names = sources.select(F.col("id").alias("_sid"), "source_name", F.col("feed_url").alias("source_feed_url"))
    return articles.join(names, F.col("source_id") == F.col("_sid")).drop("_sid")


def scan_articles(t: Tables) -> DataFrame:
    return join_source(t.content, t.sources).select(*SIMPLE)


def article_by_id(t: Tables, article_id: int) -> DataFrame:
    return scan_articles(t.with_(content=t.content.where(F.col("id") == article_id)))


def with_state(user_articles: DataFrame, interactions: DataFrame) -> DataFrame:
    """Left join of (user_id, id, ..) rows to that user's state; never-seen articles stay."""
    state = interactions.select(F.col("user_id").alias("_u"), F.col("content_id").alias("_c"),
                                F.col("is_read"), F.col("is_liked"), "interaction_at")
    joined = user_articles.join(state, (F.col("user_id") == F.col("_u")) & (F.col("id") == F.col("_c")), "left")
    return flags_defaulted(joined.drop("_u", "_c"))


def never_seen(user_articles: DataFrame) -> DataFrame:
    """What ``with_state`` gives for rows without state."""
    unset = F.lit(None).cast("boolean")
    return flags_defaulted(user_articles.withColumns({"is_read": unset, "is_liked": unset, "interaction_at": F.lit(None).cast("timestamp")}))


def flags_defaulted(df: DataFrame) -> DataFrame:
    liked = F.coalesce("is_liked", F.lit(False))
    return df.withColumns({"is_read": F.coalesce("is_read", F.lit(False)), "is_liked": liked, "is_saved": liked})


def articles_with_interactions(t: Tables) -> DataFrame:
    """The 13-column shape for every (user, article) that has state."""
    touched = t.interactions.join(t.content, F.col("content_id") == F.col("id")).drop("content_id")
    return flags_defaulted(join_source(touched, t.sources)).select("user_id", *WITH_STATE)


def with_touches(articles: DataFrame, interactions: DataFrame) -> DataFrame:
    """Articles with ``interaction_count`` and ``view_count`` (0 when nobody touched them). The state is cut to these
    articles before it is counted."""
    own = interactions.join(articles.select(F.col("id").alias("content_id")).distinct(), "content_id", "left_semi")
    joined = articles.join(per_article(own), F.col("id") == F.col("_cid"), "left").drop("_cid")
    return (joined.withColumn("interaction_count", F.coalesce("_touches", F.lit(0)))
            .withColumn("view_count", F.coalesce("_reads", F.lit(0))).drop("_touches", "_reads"))


def liked_articles(t: Tables, user_id: int | None = None) -> DataFrame:
    """Liked state rows joined to article and source."""
    liked = t.interactions.where("is_liked")
    if user_id is not None:
        liked = liked.where(F.col("user_id") == user_id)
    return articles_with_interactions(t.with_(interactions=liked))


def favorites(t: Tables, user_id: int | None = None) -> DataFrame:
    """All liked articles of a reader with their ``position``, latest like first, without a limit. Only keys are numbered, by a
    distributed sort that no busy reader overloads; the articles are fetched for them afterwards."""
    liked = one_user(t.interactions, user_id).where("is_liked")
    known = t.content.select(F.col("id").alias("content_id"), "source_id").join(t.sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    keys = liked.join(known.select("content_id"), "content_id", "left_semi").select("user_id", "content_id", "interaction_at")
    placed = position_in_group(keys, ["user_id"], [F.col("interaction_at").desc_nulls_first(), F.col("content_id")], "position")
    state = liked.join(placed.select("user_id", "content_id", F.col("position").cast("long").alias("position")), ["user_id", "content_id"])
    rows = flags_defaulted(join_source(state.join(t.content, F.col("content_id") == F.col("id")).drop("content_id"), t.sources))
    return rows.select("user_id", "position", *WITH_STATE)


def by_interest(articles: DataFrame, user_topics: DataFrame) -> DataFrame:
    """Articles of each reader's interests; a repeated interest counts once."""
    wanted = user_topics.dropDuplicates(["user_id", "topic"]).select("user_id", F.col("topic").alias("_topic"))
    return articles.join(wanted, F.col("topic") == F.col("_topic")).drop("_topic")


def without_liked(articles: DataFrame, interactions: DataFrame) -> DataFrame:
    return articles.join(liked_ids(interactions).withColumnRenamed("content_id", "_liked"),
                         F.col("id") == F.col("_liked"), "left_anti")


def without_read(user_articles: DataFrame, interactions: DataFrame) -> DataFrame:
    read = interactions.where("is_read").select(F.col("user_id").alias("_u"), F.col("content_id").alias("_c"))
    return user_articles.join(read, (F.col("user_id") == F.col("_u")) & (F.col("id") == F.col("_c")), "left_anti")


def split_by_stored_url(entries: DataFrame, content: DataFrame, url: str = "link") -> DataFrame:
    """Entries with ``existing_id``/``existing_image`` of the stored article, NULL when new."""
    stored = content.select(F.col("article_url").alias("_url"), F.col("id").alias("existing_id"),
                            F.col("image_url").alias("existing_image"))
    return entries.join(stored, F.col(url) == F.col("_url"), "left").drop("_url")


# -- filters ---------------------------------------------------------------------------

def unread(is_read: Column | str = "is_read") -> Column:
    return ~F.coalesce(is_read, F.lit(False))


def in_topics(topics: list[str]) -> Column:
    """Topic is one of ``topics``; an empty list matches nothing."""
    return F.col("topic").isin(list(topics)) if topics else F.lit(False)


def since_hours(as_of, hours: int) -> Column:
    """Published within the last ``hours``; no upper bound, so later rows pass."""
    return F.col("published_at") >= clock.hours_before(as_of, hours)


def since_days(as_of, days: int) -> Column:
    return F.col("published_at") >= clock.days_before(as_of, days)


def since_midnight_days(as_of, days: int) -> Column:
    return F.col("published_at") >= clock.midnight_days_before(as_of, days)


def since_today(as_of) -> Column:
    return since_midnight_days(as_of, 0)


def on_date(date) -> Column:
    """Published on ``date``, as a range on the timestamp so parquet statistics apply."""
    start = F.to_date(F.lit(date)) if not isinstance(date, Column) else date
    return ((F.col("published_at") >= start.cast("timestamp"))
            & (F.col("published_at") < F.date_add(start, 1).cast("timestamp")))


def has_topic() -> Column:
    return F.col("topic").isNotNull()


# -- projections -----------------------------------------------------------------------

def topic_shown(custom: str | None) -> Column:
    """A custom topic wins over the stored one; an empty one does not."""
    return F.lit(custom) if custom else F.col("topic")


def favorites_display(articles: DataFrame) -> DataFrame:
    """Summary and date as the favourites list shows them."""
    low = F.lower("summary")
    hidden = (F.coalesce(F.col("summary"), F.lit("")) == "") | low.startswith("article url:") | low.startswith("<p>article url:")
    return articles.withColumns({
        "summary_shown": F.when(hidden, F.lit("No summary available for this article.")).otherwise(F.col("summary")),
        "date_shown": F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("No date"))})
