"""Feeds for all readers at once.

A feed for every user must not pair every user with every article. Articles are ranked
once (over all, per topic, or per set of interests); a reader's unread page is then found
from the *positions* of what they have read: between two read positions lie unread ones,
so each reader contributes their reads and exactly one page of positions, nothing more.

A list is ranked only ``SPARE`` places deeper than a page. A reader who has read more than that of a
list's newest articles (a bot, say) is served apart: counts of articles and reads by day tell which days
hold the first unread ones, and only these days are ranked. So no reader lengthens the lists of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweave import clock
from newsweave.operators import articles as A
from newsweave.operators.paging import PAGE_ROWS, PageIndex, page_index
from newsweave.operators.ranking import HEAD_LIMIT, page, position_in_group, ranked_head, top_k_per_group
from newsweave.session import cut_lineage
from newsweave.sources.tables import TOPICS, Tables, distinct_users, one_user, topic_dimension, user_topics
from newsweave.operators.trends import briefing_sentence

TURN, LIST = "_turn", "_list"
#: Read articles among the newest of a list up to which a reader is served from its head; others are served day by day.
SPARE = 1000
#: Narrow rows (ids, positions, a list key) that may be broadcast when their number is bounded.
BROADCAST_ROWS = 200_000


# -- building blocks -------------------------------------------------------------------

def _known(t: Tables) -> DataFrame:
    """Keys of articles whose source exists."""
    return (t.content.select("id", "source_id", "topic", "published_at")
            .join(t.sources.select(F.col("id").alias("source_id")), "source_id", "left_semi"))


def _interests(t: Tables, user_id=None) -> DataFrame:
    return user_topics(t, user_id)


def _reads(t: Tables, user_id=None) -> DataFrame:
    return one_user(t.interactions, user_id).where("is_read").select("user_id", F.col("content_id").alias("id"))


def _head(articles: DataFrame, group: list[str], k: int, *carry: str) -> DataFrame:
    """Newest ``k`` keys per group, with the narrow columns ``carry``. Every feed uses its head several times, so it is ranked once and
    written to the shared folder (at most groups x k narrow rows)."""
    return cut_lineage(_ranked(articles, group, k, *carry))


def _ranked(articles: DataFrame, group: list[str], k: int, *carry: str) -> DataFrame:
    return ranked_head(articles.select("id", *group, *carry, "published_at"), group, A.newest_first(), k, TURN)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a broadcast side when at most ``rows`` narrow rows are few enough; else as it is, for
    a shuffle join whose skew AQE splits."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unread_positions(members: DataFrame, reads: DataFrame, key: list[str], k: int, most_reads: int) -> DataFrame:
    """First ``k`` unread positions of every member: (key.., _turn, ordinal).

    ``members`` holds the keys, ``reads`` (key.., _turn) the read positions. Position 0 is a
    virtual read, so every gap starts after a read: the i-th read at position p has p - i unread
    ones before it, and the gap after it gives positions until the next read or until k is full.
    """
    marks = members.select(*key, F.lit(0).cast("long").alias(TURN)).unionByName(reads.select(*key, F.col(TURN).cast("long").alias(TURN)))
    if most_reads <= HEAD_LIMIT:
        along = Window.partitionBy(*key).orderBy(TURN)
        marks = marks.select(*key, TURN, (F.row_number().over(along) - 1).alias("_i"), F.lead(TURN).over(along).alias("_next"))
    else:  # a reader may hold a large share of all reads: number them by a distributed sort
        placed = position_in_group(marks, key, [F.col(TURN)], "_place")
        following = placed.select(*key, (F.col("_place") - 1).alias("_place"), F.col(TURN).alias("_next"))
        marks = placed.join(following, [*key, "_place"], "left").withColumn("_i", F.col("_place") - 1)
    before = F.col(TURN) - F.col("_i")
    room = F.least(F.coalesce(F.col("_next") - F.col(TURN) - 1, F.lit(k)), F.lit(k) - before)
    gaps = marks.where(room > 0)
    return (gaps.select(*key, before.alias("_before"), F.col(TURN).alias("_from"),
                        F.explode(F.sequence(F.col(TURN) + 1, F.col(TURN) + room)).alias("_at"))
            .select(*key, F.col("_at").alias(TURN), (F.col("_before") + F.col("_at") - F.col("_from")).alias("ordinal")))


def first_unread(candidates: DataFrame, members: DataFrame, reads: DataFrame, k: int, spare: int = SPARE) -> tuple[DataFrame, DataFrame]:
    """((user_id, id, ordinal) of the first ``k`` unread articles of every member, ids they come from).

    ``candidates`` (_list, id, published_at) are the articles of each list, ``members`` (user_id, _list) says whose list it is, one
    for a reader, ``reads`` (user_id, id) what they have read."""
    head = _head(candidates, [LIST], k + spare)
    places = head.select(LIST, "id", TURN)
    # of all reads only those of articles in a head are moved
    close = reads.join(_bounded(places.select("id").distinct(), head.count()), "id", "left_semi")
    seen = cut_lineage(close.join(members, "user_id").join(places, [LIST, "id"]).select("user_id", LIST, TURN))
    at = unread_positions(members, seen, ["user_id", LIST], k, k + spare)
    near = at.join(places, [LIST, TURN]).select("user_id", "id", "ordinal")
    # of a list that ends within its head nothing lies deeper
    full = head.groupBy(LIST).count().where(F.col("count") >= k + spare).select(LIST)
    deep = seen.groupBy("user_id", LIST).count().where(F.col("count") > spare).select("user_id", LIST).join(full, LIST, "left_semi")
    if deep.isEmpty():
        return near, head.select("id")
    deep = cut_lineage(deep)
    lists = deep.select(LIST).distinct()
    far = cut_lineage(_unread_by_day(candidates.join(lists, LIST, "left_semi"), deep, reads.join(deep, "user_id"), k))
    chosen = near.join(deep.select("user_id"), "user_id", "left_anti").unionByName(far)
    return chosen, head.select("id").unionByName(far.select("id"))


def _unread_by_day(candidates: DataFrame, members: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """The same for readers with long histories, (user_id, id, ordinal).

    ``reads`` has user_id, _list and id. Days are numbered from the newest, undated articles first; a day's unread ones are its
    articles less the reads of that day. Days without a read between two days with reads are unread as a whole, so rows come from the days
    with reads and, for the first ``k`` unread articles, from at most ``k`` days behind each."""
    day = F.to_date("published_at")
    sizes = cut_lineage(candidates.groupBy(LIST, day.alias("_day")).agg(F.count("*").alias("_size")))
    # one row per list and day
    newest = Window.partitionBy(LIST).orderBy(F.col("_day").desc_nulls_first())
    days = sizes.withColumns({"_no": F.row_number().over(newest), "_before": F.sum("_size").over(newest) - F.col("_size")})
    dated = reads.join(candidates, [LIST, "id"]).select("user_id", LIST, "id", day.alias("_day"))
    counted = dated.groupBy("user_id", LIST, "_day").agg(F.count("*").alias("_reads")).withColumnRenamed("_day", "_d")
    known = days.withColumnRenamed(LIST, "_l")
    same = (F.col(LIST) == F.col("_l")) & F.col("_d").eqNullSafe(F.col("_day"))
    start = members.select("user_id", LIST, F.lit(0).alias("_no"), F.lit(0).cast("long").alias("_size"), F.lit(0).cast("long").alias("_before"), F.lit(0).cast("long").alias("_reads"))
    marks = start.unionByName(counted.join(known, same).select("user_id", LIST, "_no", "_size", "_before", "_reads"))
    along = Window.partitionBy("user_id", LIST).orderBy("_no")
    marks = marks.withColumns({
        "_skip": F.col("_before") - (F.sum("_reads").over(along) - F.col("_reads")), "_own": F.col("_size") - F.col("_reads"),
        "_next": F.lead("_no").over(along)})
    own = marks.where((F.col("_own") > 0) & (F.col("_skip") < k)).select("user_id", LIST, "_no", "_skip")
    past = marks.withColumns({"_skip": F.col("_skip") + F.col("_own"), "_from": F.col("_before") + F.col("_size")}).where(F.col("_skip") < k)
    last = F.least(F.coalesce(F.col("_next") - 1, F.col("_no") + k), F.col("_no") + F.lit(k) - F.col("_skip").cast("int"))
    gaps = past.where(last > F.col("_no")).select("user_id", LIST, "_skip", "_from", F.explode(F.sequence(F.col("_no") + 1, last)).alias("_no"))
    whole = gaps.join(days.select(LIST, "_no", "_before"), [LIST, "_no"]).select(
        "user_id", LIST, "_no", (F.col("_skip") + F.col("_before") - F.col("_from")).alias("_skip")).where(F.col("_skip") < k)
    wanted = cut_lineage(own.unionByName(whole))
    # only the days somebody needs are ranked
    chosen = days.join(wanted.select(LIST, "_no").distinct(), [LIST, "_no"], "left_semi").select(F.col(LIST).alias("_l"), F.col("_day").alias("_d"), "_no")
    rows = candidates.withColumn("_day", day).join(chosen, (F.col(LIST) == F.col("_l")) & F.col("_day").eqNullSafe(F.col("_d"))).select(LIST, "_no", "id", "published_at")
    places = position_in_group(rows, [LIST, "_no"], A.newest_first(), TURN).select(LIST, "_no", "id", TURN)
    seen = reads.join(places, [LIST, "id"]).join(wanted, ["user_id", LIST, "_no"], "left_semi").select("user_id", LIST, "_no", TURN)
    at = unread_positions(wanted.select("user_id", LIST, "_no"), seen, ["user_id", LIST, "_no"], k, HEAD_LIMIT + 1)
    found = at.join(places, [LIST, "_no", TURN]).join(wanted, ["user_id", LIST, "_no"])
    return found.select("user_id", "id", (F.col("ordinal") + F.col("_skip")).alias("ordinal")).where(F.col("ordinal") <= k)


def _details(t: Tables, ids: DataFrame) -> DataFrame:
    """Full article rows with source of the chosen ids."""
    return A.join_source(t.content.join(ids.select("id").distinct(), "id", "left_semi"), t.sources)


def _shown(t: Tables, chosen: DataFrame, ids: DataFrame, *extra: str) -> DataFrame:
    """(user_id, id, extra..) rows in the 13-column shape. State is cut to the chosen ids first and joined to the narrow
    rows; the articles with their texts come last, by id alone, so no text is moved with a reader."""
    state = t.interactions.join(ids.select(F.col("id").alias("content_id")).distinct(), "content_id", "left_semi")
    flagged = A.with_state(chosen.select("user_id", "id", *extra), state)
    return flagged.join(_details(t, ids), "id").select("user_id", *extra, *A.WITH_STATE)


# -- general ---------------------------------------------------------------------------

def digest_index(t: Tables, page_rows: int = PAGE_ROWS) -> PageIndex:
    """Index over the keys of all articles with a source, for digests at any depth."""
    return page_index(_known(t).select("id", "published_at"), page_rows)


def general_digest(t: Tables, limit: int = 20, offset: int = 0, index: PageIndex | None = None) -> DataFrame:
    """Newest articles for everybody. Keys are ranked, or looked up in an ``index``; details are fetched for the page only."""
    best = page(_known(t).select("id", "published_at"), A.newest_first(), limit, offset) if index is None else index.page(limit, offset)
    return _details(t, best).select(*A.SIMPLE).orderBy(*A.newest_first())


def _unread_general(t: Tables, members: DataFrame, k: int, user_id=None) -> tuple[DataFrame, DataFrame]:
    """((user_id, id, ordinal) of the first ``k`` unread articles per member, ids they come from): one list for all."""
    everything = F.lit("").alias(LIST)
    return first_unread(_known(t).select(everything, "id", "published_at"), members.select("user_id", everything), _reads(t, user_id), k)


def personalized_digest(t: Tables, user_id: int | None = None, limit: int = 20, offset: int = 0,
                        include_read: bool = False) -> DataFrame:
    """Newest articles per reader, unread ones unless ``include_read``; ``position`` starts at 1."""
    members = one_user(distinct_users(t), user_id)
    k = limit + offset
    if include_read:
        head = _head(_known(t), [], k)
        slots = members.select("user_id", F.explode(F.sequence(F.lit(offset + 1), F.lit(k))).alias(TURN))
        chosen = slots.join(_bounded(head.select("id", TURN), k), TURN).select("user_id", "id", F.col(TURN).alias("ordinal"))
    else:
        chosen, head = _unread_general(t, members, k, user_id)
    chosen = chosen.where(F.col("ordinal") > offset).withColumn("position", F.col("ordinal") - offset)
    return _shown(t, chosen, head, "position")


# -- by interest -----------------------------------------------------------------------

def interest_sets(user_topics: DataFrame) -> DataFrame:
    """(user_id, _list, topics): each reader's set of interests, which names a list; a repeated interest counts once. There are at most
    2^topics lists."""
    sets = user_topics.where(A.has_topic()).groupBy("user_id").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    return sets.select("user_id", F.array_join("topics", "\n").alias(LIST), "topics")


def list_topics(sets: DataFrame) -> DataFrame:
    """(_list, topic) of the lists that somebody has."""
    return sets.select(LIST, "topics").distinct().select(LIST, F.explode("topics").alias("topic"))


def _interest_lists(recent: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Newest ``k`` articles of every set of interests: (_list, id, published_at, _turn). A list's newest k are among the newest k of each of its
    topics, so topics are cut before they meet."""
    head = _ranked(recent.where(A.has_topic()), ["topic"], k).drop(TURN)
    listed = head.join(F.broadcast(list_topics(sets)), "topic").select(LIST, "id", "published_at")
    return cut_lineage(top_k_per_group(listed, [LIST], A.newest_first(), k, TURN))


def served(sets: DataFrame, lists: DataFrame, k: int, *carry: str) -> DataFrame:
    """(user_id, id, _turn, carry..): each reader's list. The lists are at most 2^topics x k narrow rows."""
    places = _bounded(lists.select(LIST, "id", TURN, *carry), 2 ** len(TOPICS) * k)
    return sets.select("user_id", LIST).join(places, LIST).select("user_id", "id", TURN, *carry)


def topic_feed(t: Tables, as_of, hours: int = 24, user_id: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest articles of a reader's interests within ``hours`` (168 for seven days); read ones stay."""
    sets = interest_sets(_interests(t, user_id))
    lists = _interest_lists(_known(t).where(A.since_hours(as_of, hours)), sets, limit + offset)
    chosen = served(sets, lists, limit + offset).where(F.col(TURN) > offset).withColumn("position", F.col(TURN) - offset).drop(TURN)
    return _shown(t, chosen, lists.select("id"), "position")


def fast_view(t: Tables, as_of, user_id: int | None = None) -> DataFrame:
    """Quick unread list per reader, with the rule that filled it in ``slot``:

    interests - newest 30 of seven days, read ones then dropped; fallback - nothing was left there:
    newest 10 unread of all topics; general - no interests: newest 30 unread.
    """
    sets = interest_sets(_interests(t, user_id))
    lists = _interest_lists(_known(t).where(A.since_hours(as_of, 168)), sets, 30)
    newest = served(sets, lists, 30).withColumnRenamed(TURN, "position")
    unread = newest.join(_reads(t, user_id), ["user_id", "id"], "left_anti").select("user_id", "id", "position")
    feed = _shown(t, unread, lists.select("id"), "position").withColumn("slot", F.lit("interests"))
    interested = _interests(t, user_id).select("user_id").distinct()
    reached = unread.select("user_id").distinct()
    others = (one_user(distinct_users(t), user_id).join(reached, "user_id", "left_anti")
              .join(interested.withColumn("_wants", F.lit(True)), "user_id", "left")
              .select("user_id", F.coalesce("_wants", F.lit(False)).alias("_wants")))
    chosen, head = _unread_general(t, others.select("user_id"), 30, user_id)
    most = F.when(F.col("_wants"), 10).otherwise(30)
    chosen = (chosen.join(others, "user_id").where(F.col("ordinal") <= most)
              .select("user_id", "id", F.col("ordinal").alias("position"),
                      F.when(F.col("_wants"), "fallback").otherwise("general").alias("slot")))
    return feed.unionByName(_shown(t, chosen, head, "position", "slot"))


def fast_batch(t: Tables, as_of, user_id: int | None = None, offset: int = 0, limit: int = 20, cap: int | None = None) -> DataFrame:
    """One page of unread articles per reader and how many there are (``total_unread``).

    Readers with interests read the articles of seven days in these, whatever the topics are; lists are built once
    per distinct *set* of interests, not per reader, and only ``SPARE`` places deeper than the page. Totals are counts: those of the topics of the set (an article has one topic),
    without what the reader has seen of them. Others read all articles. With ``cap`` each list ends after so many
    articles, and no total exceeds it.
    """
    k = offset + limit if cap is None else min(offset + limit, cap)
    everyone = one_user(distinct_users(t), user_id)
    interests = _interests(t, user_id).where(A.has_topic())
    sets = cut_lineage(interest_sets(_interests(t, user_id)))
    members = sets.select("user_id", LIST)
    reads = _reads(t, user_id)
    recent = _known(t).where(A.since_hours(as_of, 168) & A.has_topic()).select("id", "topic", "published_at")
    wanted = list_topics(sets)
    if cap is None:
        lists = recent.join(F.broadcast(wanted), "topic").select(LIST, "id", "published_at")
        per_topic = recent.groupBy("topic").agg(F.count("*").alias("_n"))
        sizes = wanted.join(per_topic, "topic").groupBy(LIST).agg(F.sum("_n").alias("_size"))
        seen_rows = reads.join(recent.select("id", "topic"), "id").join(interests, ["user_id", "topic"], "left_semi")
    else:
        lists = _interest_lists(recent, sets, cap).drop(TURN)
        sizes = lists.groupBy(LIST).agg(F.count("*").alias("_size"))
        seen_rows = reads.join(members, "user_id").join(lists.select(LIST, "id"), [LIST, "id"], "left_semi")
    seen_n = seen_rows.groupBy("user_id").agg(F.count("*").alias("_seen"))
    by_interest, shown = first_unread(lists, members, reads, k)
    by_interest = by_interest.where(F.col("ordinal") > offset)
    totals = (members.join(sizes, LIST).join(seen_n, "user_id", "left")
              .select("user_id", (F.col("_size") - F.coalesce("_seen", F.lit(0))).alias("total_unread")))
    # readers without interests
    rest = everyone.join(interests.select("user_id").distinct(), "user_id", "left_anti")
    general, top = _unread_general(t, rest, k, user_id)
    known = _known(t).select("id")
    stored = known.agg(F.count("*").alias("n")).scalar()
    read_n = reads.join(rest, "user_id", "left_semi").join(known, "id", "left_semi").groupBy("user_id").agg(F.count("*").alias("_seen"))
    unread = stored - F.coalesce("_seen", F.lit(0))
    general_totals = rest.join(read_n, "user_id", "left").select(
        "user_id", (unread if cap is None else F.least(unread, F.lit(cap))).alias("total_unread"))
    chosen = (by_interest.unionByName(general.where(F.col("ordinal") > offset))
              .join(totals.unionByName(general_totals), "user_id")
              .withColumn("position", F.col("ordinal") - offset))
    return _shown(t, chosen, shown.unionByName(top), "position", "total_unread")


# -- home ------------------------------------------------------------------------------

def newest_pool(t: Tables, pool: int = 80) -> DataFrame:
    """Keys and topics of the newest ``pool`` articles."""
    return _head(_known(t), [], pool, "topic")


def topn_per_topic(t: Tables, pool: int = 80, per_topic: int = 10, head: DataFrame | None = None) -> DataFrame:
    """Topic sections out of the newest ``pool`` articles. The pool is cut **before** topics are
    looked at; a topic without articles keeps one row with NULL article columns."""
    head = newest_pool(t, pool) if head is None else head
    articles = _details(t, head).select(*A.SIMPLE)
    ranked = top_k_per_group(articles.where(A.has_topic()), ["topic"], A.newest_first(), per_topic, "position")
    topics = topic_dimension(t.spark).select(F.col("k").alias("section_order"), F.col("topic").alias("section"))
    return topics.join(ranked, F.col("section") == F.col("topic"), "left")


def recommended_section(t: Tables, user_id: int | None = None, pool: int = 80, per_topic: int = 10, head: DataFrame | None = None) -> DataFrame:
    """Per reader: the newest articles of the pool in their interests."""
    head = newest_pool(t, pool) if head is None else head
    sets = interest_sets(_interests(t, user_id))
    # at most ``pool`` articles in each of the lists
    listed = head.where(A.has_topic()).join(F.broadcast(list_topics(sets)), "topic").select(LIST, "id", "published_at")
    lists = top_k_per_group(listed, [LIST], A.newest_first(), per_topic, TURN)
    return _shown(t, served(sets, lists, per_topic).withColumnRenamed(TURN, "position"), head, "position")


def home_sections(t: Tables, user_id: int | None = None, pool: int = 80, per_topic: int = 10) -> DataFrame:
    """Home page: (section, user_id, position, article..). Topic sections are the same for every
    reader, so they appear once with a NULL user_id; the recommended section has rows per reader."""
    head = newest_pool(t, pool)
    shared = topn_per_topic(t, pool, per_topic, head).select(
        "section", F.lit(None).cast("long").alias("user_id"), F.col("position"), "id", "title", "published_at", "source_name")
    own = recommended_section(t, user_id, pool, per_topic, head).select(
        F.lit("Recommended For You").alias("section"), "user_id", "position", "id", "title", "published_at", "source_name")
    return shared.unionByName(own)


def user_top_articles(t: Tables, as_of, user_id: int | None = None, limit: int = 5) -> DataFrame:
    """Today's newest unread articles of a reader's interests. Unread positions are taken per (reader,
    topic), then the best ``limit`` of those few."""
    today = _known(t).where(A.since_today(as_of) & A.has_topic())
    sets = cut_lineage(interest_sets(_interests(t, user_id)))
    lists = today.join(F.broadcast(list_topics(sets)), "topic").select(LIST, "id", "published_at")
    ranked, head = first_unread(lists, sets.select("user_id", LIST), _reads(t, user_id), limit)
    ranked = ranked.withColumnRenamed("ordinal", "position")
    details = t.content.join(head.select("id"), "id", "left_semi").select(
        "id", "title", "summary", "topic", F.col("article_url").alias("url"))
    return ranked.select("user_id", "position", "id").join(details, "id").select(
        "user_id", "position", "id", "title", "summary", "topic", "url")


def daily_digest_table(t: Tables, as_of, limit: int = 5) -> DataFrame:
    """(user_id, date, summary, article_ids): the briefing of each reader's top articles of the day."""
    top = user_top_articles(t, as_of, None, limit).select("user_id", "position", "id", "topic")
    listed = F.sort_array(F.collect_list(F.struct("position", "id", "topic")))
    return (top.groupBy("user_id").agg(listed.alias("_l"))  # at most ``limit`` rows per reader
            .select("user_id", clock.day(as_of).alias("date"),
                    briefing_sentence(F.transform("_l", lambda r: r["topic"])).alias("summary"),
                    F.transform("_l", lambda r: r["id"]).alias("article_ids")))
