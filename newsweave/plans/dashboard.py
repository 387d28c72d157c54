"""Trend dashboard and job status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave import clock
from newsweave.operators import articles as A
from newsweave.operators import trends as T
from newsweave.session import cut_lineage
from newsweave.sources.tables import Tables


def dashboard(t: Tables, as_of, partials: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five parts of the dashboard. The articles of the last day are counted once, from the state or from a table of hourly
    counts; topics, companies, articles and the briefing are added up from these."""
    counts = cut_lineage(T.recent_counts(t, as_of, 24, partials))
    return {
        "trending_topics": T.trending_topics_counts(t, as_of, counts=counts),
        "trending_companies": T.trending_companies(t, as_of, counts=counts),
        "topic_share": T.topic_share(t, as_of),
        "trending_articles": T.trending_articles(t, as_of, 24, 6, counts),
        "briefing": T.briefing_text(counts.where(A.has_topic()).withColumnRenamed("interaction_count", "interactions")),
    }


def dashboard_rows(t: Tables, as_of, partials: DataFrame | None = None) -> DataFrame:
    """The dashboard as one table (part, label, count, score)."""
    parts = dashboard(t, as_of, partials)
    row = lambda name, label, count, score: parts[name].select(
        F.lit(name).alias("part"), label.alias("label"), count.cast("double").alias("count"), score.cast("double").alias("score"))
    none = F.lit(None)
    return (row("trending_topics", F.col("topic"), F.col("article_count"), F.col("interaction_count"))
            .unionByName(row("trending_companies", F.col("company"), F.col("mentions"), F.col("interaction_score")))
            .unionByName(row("topic_share", F.col("topic"), F.col("article_count"), F.col("percentage")))
            .unionByName(row("trending_articles", F.col("title"), F.col("id"), F.col("interactions")))
            .unionByName(row("briefing", F.col("briefing"), none, none)))


def job_status(t: Tables, as_of) -> DataFrame:
    """Content statistics with the answer fields of a status request; ``top_topics`` lists the largest topics as
    (topic, count)."""
    largest = T.content_top_topics(t).agg(F.sort_array(F.collect_list(F.struct((-F.col("article_count")).alias("n"), "topic"))).alias("l"))
    listed = largest.select(F.transform("l", lambda r: F.struct(r["topic"].alias("topic"), (-r["n"]).alias("count")))).scalar()
    return T.content_stats(t, as_of).withColumns({
        "top_topics": listed,
        "success": F.lit(True), "timestamp": clock.instant(as_of), "message": F.lit("Job status retrieved successfully")})
