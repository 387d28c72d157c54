"""Articles of readers' interests over all dates, page by page, without joining readers to topics.

Articles are sorted once per topic (runs). Readers with the same set of interests share a list, which is the merge of the runs of
its topics. A page takes the next ``k`` places of each run behind the list's cursor and keeps the newest ``k`` of them; the cursor then moves by
what was taken of each run. So a page costs lists x topics x k narrow rows, whatever a topic holds and however deep the
page lies, and each reader gets exactly one page. ``articles_of_interests`` gives every reader the whole list instead, and ``split_by_state`` the
same pairs parted by whether a stored state knows them. Pairs of a reader and an article are made where they are used and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.operators import articles as A
from newsweave.operators.ranking import position_in_group, ranked_head, top_k_per_group
from newsweave.plans.feeds import LIST, TURN, interest_sets, list_topics, served
from newsweave.session import cut_lineage

PLACE = "_place"
#: Whole lists meet their readers in pieces of so many articles and about so many readers, so what is moved is a small part of the pairs.
ARTICLES, READERS = 1000, 1000
#: Pairs that a task is to make, and most tasks. Their number comes from the pairs: the planner would see the few rows moved and take few tasks.
TASK_PAIRS, MOST_TASKS = 2_000_000, 5000
PIECE = [LIST, "_part", "_crew"]


def topic_runs(articles: DataFrame, depth: int | None = None) -> DataFrame:
    """(topic, id, published_at, _place): articles numbered in their topic, newest first; with ``depth`` only the first ones, which are cut
    below the shuffle. Whole runs come from one range-partitioned sort, so a hot topic is spread over tasks."""
    keys = articles.where(A.has_topic()).select("topic", "id", "published_at")
    if depth is None:
        return position_in_group(keys, ["topic"], A.newest_first(), PLACE)
    return cut_lineage(ranked_head(keys, ["topic"], A.newest_first(), depth, PLACE))


def first_cursor(sets: DataFrame) -> DataFrame:
    """(_list, topic, _place): how much of each run a list has taken, nothing yet."""
    return list_topics(sets).withColumn(PLACE, F.lit(0).cast("long"))


def next_places(runs: DataFrame, cursor: DataFrame, k: int) -> DataFrame:
    """The next ``k`` articles of each list behind its cursor: (_list, topic, id, published_at, _turn), _turn from 1."""
    slots = cursor.select(LIST, "topic", F.explode(F.sequence(F.col(PLACE) + 1, F.col(PLACE) + k)).alias(PLACE))
    offered = slots.join(runs.withColumn(PLACE, F.col(PLACE).cast("long")), ["topic", PLACE])
    return top_k_per_group(offered.select(LIST, "topic", "id", "published_at"), [LIST], A.newest_first(), k, TURN)


def moved(cursor: DataFrame, taken: DataFrame) -> DataFrame:
    """The cursor behind a page of ``next_places``: the continuation key of the next one."""
    used = taken.groupBy(LIST, "topic").agg(F.count("*").alias("_used"))
    return cursor.join(used, [LIST, "topic"], "left").select(LIST, "topic", (F.col(PLACE) + F.coalesce("_used", F.lit(0))).alias(PLACE))


def interest_page(runs: DataFrame, sets: DataFrame, k: int, cursor: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((user_id, id, topic, published_at, position) of one page for every reader of ``sets``, cursor of the next page)."""
    cursor = first_cursor(sets) if cursor is None else cursor
    lists = cut_lineage(next_places(runs, cursor, k))
    rows = served(sets, lists, k, "topic", "published_at").withColumnRenamed(TURN, "position")
    return rows, moved(cursor, lists)


def page_of_interests(articles: DataFrame, user_topics: DataFrame, k: int, pages: int = 1) -> DataFrame:
    """The first ``pages`` pages of ``k`` articles for every reader with interests."""
    sets = cut_lineage(interest_sets(user_topics))
    runs, cursor, out = topic_runs(articles, k * pages), None, None
    for n in range(pages):
        rows, cursor = interest_page(runs, sets, k, cursor)
        rows = rows.withColumn("position", F.col("position") + n * k)
        out = rows if out is None else out.unionByName(rows)
    return out


def numbered_lists(articles: DataFrame, sets: DataFrame) -> DataFrame:
    """(_list, id, topic, published_at, position): the whole list of every set of interests, numbered newest first by a distributed sort."""
    listed = articles.where(A.has_topic()).select("topic", "id", "published_at").join(list_topics(sets), "topic")
    return cut_lineage(position_in_group(listed.select(LIST, "topic", "id", "published_at"), [LIST], A.newest_first(), "position"))


def part_of(position: str = "position") -> Column:
    """Part of a list in which a position lies."""
    return F.floor((F.col(position) - 1) / ARTICLES).cast("int").alias("_part")


def in_pieces(sets: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(readers in every part of their list, the lists for every crew of their readers, number of tasks). Both carry the columns of
    ``PIECE``; a piece has at most ``ARTICLES`` articles and about ``READERS`` readers."""
    sizes = lists.groupBy(LIST).agg(F.count("*").alias("_articles")).join(sets.groupBy(LIST).agg(F.count("*").alias("_readers")), LIST)
    sizes = cut_lineage(sizes.withColumns({"_parts": F.ceil(F.col("_articles") / ARTICLES).cast("int"), "_crews": F.ceil(F.col("_readers") / READERS).cast("int")}))
    pairs = sizes.select(F.sum(F.col("_articles") * F.col("_readers"))).first()[0] or 0
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    readers = sets.select("user_id", LIST).join(sizes, LIST).select(
        "user_id", LIST, F.pmod(F.xxhash64("user_id"), "_crews").cast("int").alias("_crew"), every("_parts").alias("_part"))
    rows = lists.join(sizes.select(LIST, "_crews"), LIST).select(*lists.columns, part_of(), every("_crews").alias("_crew"))
    return readers, rows, max(1, min(MOST_TASKS, -(-pairs // TASK_PAIRS)))


def met(readers: DataFrame, rows: DataFrame, tasks: int) -> DataFrame:
    """Every reader of a piece with every article of it."""
    return readers.repartition(tasks, *PIECE).join(rows.repartition(tasks, *PIECE), PIECE)


def articles_of_interests(articles: DataFrame, user_topics: DataFrame) -> DataFrame:
    """(user_id, id, topic, published_at, position): every article of each reader's interests, numbered newest first. Lists are sorted and
    numbered once per set of interests, by a distributed sort; only then do they meet the readers, so no reader's list is sorted by itself."""
    sets = cut_lineage(interest_sets(user_topics))
    return met(*in_pieces(sets, numbered_lists(articles, sets))).select("user_id", "id", "topic", "published_at", "position")


def split_by_state(articles: DataFrame, user_topics: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (user_id, id) of ``articles_of_interests`` in two tables: those with a row in ``state``, and all others.

    The rows of the state are looked up in the lists, not the pairs in the state, so the first table is no larger than the state's part in the
    lists. Of the second a reader brings along the places to leave out in each part of a list, ``ARTICLES`` at most."""
    sets = cut_lineage(interest_sets(user_topics))
    lists = numbered_lists(articles, sets).select(LIST, "id", "position")
    keys = state.select("user_id", F.col("content_id").alias("id")).distinct()
    known = cut_lineage(keys.join(sets.select("user_id", LIST), "user_id").join(lists, [LIST, "id"]).select("user_id", "id", "position"))
    places = known.groupBy("user_id", part_of()).agg(F.collect_list("position").alias("_known"))
    readers, rows, tasks = in_pieces(sets, lists)
    rest = met(readers.join(places, ["user_id", "_part"], "left"), rows, tasks)
    rest = rest.where(~F.coalesce(F.array_contains("_known", F.col("position")), F.lit(False)))
    return known.select("user_id", "id"), rest.select("user_id", "id")
