"""Table maintenance. Every operator returns the **new state** of a table (or a report); the
caller writes it with ``sources.sinks.replace_partitions`` or to a new path, never over its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import clock
from newsweave.operators import articles as A
from newsweave.operators.ranking import first_per_group, position_in_group
from newsweave.schemas import MAX_LENGTHS
from newsweave.session import cut_lineage
from newsweave.sources.rewrite import delete_rows
from newsweave.sources.tables import Tables

# -- retention -------------------------------------------------------------------------

# What a retention run reports, by how much fresh content there is ({n} articles).
ENOUGH = "Fresh content available ({n} new articles)"
SOME = "Limited fresh content ({n} new), extended retention to 48h"
TOO_FEW = "Insufficient fresh content ({n} new articles). Preserving existing content to prevent empty site."


def retention_counts(t: Tables, as_of) -> DataFrame:
    """Fresh today, published yesterday and total, all without liked articles; one row."""
    today = clock.day(as_of)
    return A.without_liked(t.content.select("id", "published_at"), t.interactions).agg(
        F.count_if(A.on_date(today)).alias("fresh_today"),
        F.count_if(A.on_date(F.date_sub(today, 1))).alias("yesterday_count"),
        F.count("*").alias("total_available"))


def retention_rule(counts: DataFrame, as_of, min_fresh: int = 10, min_total: int = 20) -> DataFrame:
    """Adds action, reason and the cutoff (NULL = delete nothing) to the counts row."""
    fresh, total = F.col("fresh_today"), F.col("total_available")
    enough, some = fresh >= min_fresh, (fresh > 0) & (total > min_total)
    n = fresh.cast("string")
    return counts.withColumns({
        "action_taken": F.when(enough, "cleanup_performed").when(some, "conservative_cleanup").otherwise("cleanup_skipped"),
        "reason": F.replace(F.when(enough, ENOUGH).when(some, SOME).otherwise(TOO_FEW), F.lit("{n}"), n),
        "cutoff": F.when(enough, clock.hours_before(as_of, 24)).when(some, clock.hours_before(as_of, 48))})


def expired(t: Tables, cutoff: Column) -> DataFrame:
    """Ids of the articles before ``cutoff`` that nobody likes. Only old ids meet the liked ids; undated articles, and a NULL
    cutoff, expire nothing."""
    return A.without_liked(t.content.where(F.col("published_at") < cutoff).select("id"), t.interactions)


def _drop_old(t: Tables, cutoff: Column) -> DataFrame:
    """Content without what has expired."""
    gone = expired(t, cutoff).withColumnRenamed("id", "_gone")
    return t.content.join(gone, F.col("id") == F.col("_gone"), "left_anti")


def smart_cutoff(t: Tables, as_of, min_fresh: int = 10, min_total: int = 20) -> Column:
    """Cutoff of the adaptive rule, as a scalar subquery."""
    return retention_rule(retention_counts(t, as_of), as_of, min_fresh, min_total).select("cutoff").scalar()


def retention_in_place(t: Tables, path: str, schema, cutoff: Column) -> list[tuple]:
    """Delete what has expired from the content table at ``path``, partitioned by ``published_on``, of which ``t.content`` is a view.
    Only partitions up to the day of the cutoff are looked at, and only those that lose an article are written anew; returns these."""
    day = F.coalesce(F.to_date(cutoff), F.lit("1970-01-01").cast("date"))
    old = t.with_(content=t.content.where(F.col("published_on") <= day))
    return delete_rows(t.spark, path, schema, cut_lineage(expired(old, cutoff)), ["id"], ["published_on"])


def retention_smart(t: Tables, as_of, min_fresh: int = 10, min_total: int = 20) -> DataFrame:
    """Content after the adaptive rule: 24 hours are kept when there is enough fresh content, 48
    when there is some, everything otherwise. The cutoff is a scalar subquery."""
    return _drop_old(t, smart_cutoff(t, as_of, min_fresh, min_total))


def retention_report(t: Tables, as_of, min_fresh: int = 10, min_total: int = 20) -> DataFrame:
    """One row: counts, deleted_count, action and reason of the adaptive rule."""
    # both possible deletions are counted beside the three counts: one scan, one anti join
    at = F.col("published_at")
    counted = A.without_liked(t.content.select("id", "published_at"), t.interactions).agg(
        F.count_if(at < clock.hours_before(as_of, 24)).alias("n24"), F.count_if(at < clock.hours_before(as_of, 48)).alias("n48"),
        F.count_if(A.on_date(clock.day(as_of))).alias("fresh_today"),
        F.count_if(A.on_date(F.date_sub(clock.day(as_of), 1))).alias("yesterday_count"), F.count("*").alias("total_available"))
    rule = retention_rule(counted, as_of, min_fresh, min_total)
    deleted = F.when(F.col("action_taken") == "cleanup_performed", F.col("n24")).when(
        F.col("action_taken") == "conservative_cleanup", F.col("n48")).otherwise(F.lit(0))
    return rule.select("fresh_today", "yesterday_count", "total_available", deleted.alias("deleted_count"), "action_taken", "reason")


def retention_days(t: Tables, as_of, days: int = 30) -> DataFrame:
    """Content without articles older than ``days``, liked ones excepted."""
    return _drop_old(t, clock.days_before(as_of, days))


# -- deletes that carry on -------------------------------------------------------------

def cascade_delete(t: Tables, source_ids: DataFrame | None = None, content_ids: DataFrame | None = None,
                   user_ids: DataFrame | None = None) -> Tables:
    """Tables without the given sources, articles or users and without their dependants.
    Each key table is one column named id (user_id for users)."""
    sources, content, state, interests, users = t.sources, t.content, t.interactions, t.user_topics, t.users
    if source_ids is not None:
        sources = sources.join(source_ids.select("id"), "id", "left_anti")
        content = content.join(source_ids.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    if content_ids is not None:
        content = content.join(content_ids.select("id"), "id", "left_anti")
    if source_ids is not None or content_ids is not None:
        state = state.join(content.select(F.col("id").alias("content_id")), "content_id", "left_semi")
    if user_ids is not None:
        gone = user_ids.select("user_id")
        state, interests = state.join(gone, "user_id", "left_anti"), interests.join(gone, "user_id", "left_anti")
        users = None if users is None else users.join(gone, "user_id", "left_anti")
    return Tables(sources, content.select(*t.content.columns), state.select(*t.interactions.columns), interests, users)


# -- sources ---------------------------------------------------------------------------

def key_set_difference(current: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, change): 'remove' for keys only in ``current``, 'add' for keys only in ``target``."""
    a, b = current.select(key).distinct(), target.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("change", F.lit("remove"))
            .unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("add"))))


def sync_sources(current: DataFrame, target: DataFrame, as_of=None) -> DataFrame:
    """Source table after a sync: sources whose feed is not in ``target`` (name, url) are gone, new
    feeds are appended with the next ids in url order, known ones stay as they are, with all columns. New rows are
    created and updated at ``as_of``; their other columns are NULL."""
    wanted = target.groupBy(F.col("url").alias("feed_url")).agg(F.min("name").alias("source_name"))
    kept = current.join(wanted.select("feed_url"), "feed_url", "left_semi").select(*current.columns)
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    new = position_in_group(wanted.join(current.select("feed_url"), "feed_url", "left_anti"), [], [F.col("feed_url")], "_n")
    times = {c: clock.instant(as_of) for c in ("created_at", "updated_at") if c in current.columns and as_of is not None}
    new = new.withColumn("id", (top + F.col("_n")).cast(current.schema["id"].dataType)).drop("_n").withColumns(times)
    return kept.unionByName(new, allowMissingColumns=True)


def update_source_partial(sources: DataFrame, patch: DataFrame, as_of) -> DataFrame:
    """Sources with the non-empty fields of ``patch`` (id, source_name, feed_url) applied;
    ``updated_at`` moves only where a patch sets a field."""
    given = patch.select(F.col("id").alias("_id"), F.nullif("source_name", F.lit("")).alias("_name"),
                         F.nullif("feed_url", F.lit("")).alias("_url"))
    changed = F.col("_name").isNotNull() | F.col("_url").isNotNull()
    return (sources.join(given, F.col("id") == F.col("_id"), "left")
            .withColumns({"source_name": F.coalesce("_name", "source_name"), "feed_url": F.coalesce("_url", "feed_url"),
                          "updated_at": touch_updated_at(F.col("updated_at"), changed, as_of)})
            .select(*sources.columns))


def touch_updated_at(updated_at: Column, changed: Column, as_of) -> Column:
    return F.when(changed, clock.instant(as_of)).otherwise(updated_at)


def active_sources(sources: DataFrame, flag: str = "is_active") -> DataFrame:
    return sources.where(F.coalesce(flag, F.lit(False)))


def sources_by_category(sources: DataFrame, category: str, column: str = "category") -> DataFrame:
    return sources.where(F.col(column) == category)


# -- readers ---------------------------------------------------------------------------

def replace_user_topics(user_topics: DataFrame, new: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """Interests after the users in ``new`` (and in ``cleared``) replaced their whole list."""
    changed = new.select("user_id")
    if cleared is not None:
        changed = changed.unionByName(cleared.select("user_id"))
    kept = user_topics.join(changed.distinct(), "user_id", "left_anti")
    return kept.select("user_id", "topic").unionByName(new.select("user_id", "topic"))


# Accepted preference values.
SUMMARY_TYPES = ["tldr", "key-points"]
SUMMARY_LENGTHS = ["short", "medium", "long"]


def preference_defaults(users: DataFrame, prefs: DataFrame) -> DataFrame:
    """Preferences of every user, with the defaults where nothing is stored."""
    return users.join(prefs.select("user_id", "summary_type", "summary_length"), "user_id", "left").select(
        "user_id", F.coalesce("summary_type", F.lit("tldr")).alias("summary_type"),
        F.coalesce("summary_length", F.lit("short")).alias("summary_length"))


def valid_preferences() -> Column:
    return F.col("summary_type").isin(SUMMARY_TYPES) & F.col("summary_length").isin(SUMMARY_LENGTHS)


def set_preferences(prefs: DataFrame, patch: DataFrame, as_of) -> DataFrame:
    """Preferences with valid patches applied; a patch with any unknown value is refused whole. A reader without a row gets one."""
    good = patch.where(valid_preferences()).select(
        "user_id", F.col("summary_type").alias("_t"), F.col("summary_length").alias("_l"))
    return prefs.join(good, "user_id", "full").select(
        "user_id", F.coalesce("_t", "summary_type").alias("summary_type"),
        F.coalesce("_l", "summary_length").alias("summary_length"),
        touch_updated_at(F.col("updated_at"), F.col("_t").isNotNull(), as_of).alias("updated_at"))


def user_lookup(users: DataFrame, **equal) -> DataFrame:
    """Users with the given column values (user_id, username or email)."""
    for name, value in equal.items():
        users = users.where(F.col(name) == F.lit(value))
    return users


def unique_violation_report(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows refused because an earlier row (smaller ``order`` columns) has the same key. Rows of
    repeated keys are compared with the one kept row of the key, not with each other."""
    turn = F.struct(*order)
    kept = rows.groupBy(F.col(key).alias("_key")).agg(F.min(turn).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return rows.join(kept, F.col(key) == F.col("_key")).where(turn > F.col("_first")).select(*rows.columns)


# -- expiring records ------------------------------------------------------------------

def valid_codes(records: DataFrame, as_of) -> DataFrame:
    """Unused and not yet expired."""
    return records.where(~F.col("used") & (F.col("expires_at") > clock.instant(as_of)))


def latest_valid_per_key(records: DataFrame, as_of, key: str = "user_id") -> DataFrame:
    return first_per_group(valid_codes(records, as_of), [key], [F.col("created_at").desc(), F.col("id").desc()])


def keep_first_per_group(records: DataFrame, group: list[str], among: Column | None = None) -> DataFrame:
    """Without the rows that repeat a group among the ``among`` rows: the smallest id stays."""
    marked = records if among is None else records.where(among)
    first = marked.groupBy(*group).agg(F.min("id").alias("id")).select("id")
    extra = marked.select("id").join(first, "id", "left_anti")
    return records.join(extra, "id", "left_anti")


def ttl_purge(records: DataFrame, as_of) -> DataFrame:
    return records.where(~(F.col("used") | (F.col("expires_at") < clock.instant(as_of))))


def invalidate_then_insert(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records after new codes came in: of the unused codes of a key with a new one only its newest
    new code stays unused."""
    newest = new.groupBy("user_id").agg(F.max("id").alias("_newest"))
    return (records.unionByName(new).join(newest, "user_id", "left")
            .withColumn("used", F.col("used") | F.coalesce(F.col("id") != F.col("_newest"), F.lit(False)))
            .select(*records.columns))


# -- runs ------------------------------------------------------------------------------

def job_result(added: DataFrame, as_of) -> DataFrame:
    """Run-log row of an ingest: how many rows ``added`` holds."""
    return added.agg(F.count("*").alias("articles_added")).select(
        F.lit(True).alias("success"), "articles_added", F.lit(None).cast("string").alias("error"),
        clock.instant(as_of).alias("run_at"))


def failed_run(spark, error: str, as_of) -> DataFrame:
    """Run-log row of a run that raised ``error``."""
    return spark.range(1).select(F.lit(False).alias("success"), F.lit(None).cast("long").alias("articles_added"),
                                 F.lit(error).alias("error"), clock.instant(as_of).alias("run_at"))


def high_water_mark(run_log: DataFrame) -> DataFrame:
    """Time of the last successful run; one row, NULL before the first."""
    return run_log.where("success").agg(F.max("run_at").alias("last_ingested_at"))


def ensure_singleton(current: DataFrame, default: DataFrame) -> DataFrame:
    """``current``, or ``default`` when it has no row."""
    n = current.limit(1).agg(F.count("*").alias("n")).scalar()
    return current.unionByName(default.where(n == 0))


def first_row_value(df: DataFrame, value: str, order: str = "id") -> DataFrame:
    """Value of the row with the smallest ``order``."""
    return df.agg(F.min_by(value, order).alias(value))


def within_lengths(columns: dict[str, str]) -> Column:
    """Every mapped column fits the model's bound: {column: bound name}."""
    ok = F.lit(True)
    for column, bound in columns.items():
        ok = ok & (F.coalesce(F.length(column), F.lit(0)) <= MAX_LENGTHS[bound])
    return ok
