"""Readers with long histories: equal pages, and nobody else's list grows with them."""

import random
from datetime import datetime, timedelta

import pytest

from newsweave.operators import articles as A
from newsweave.plans import feeds as P
from newsweave.sources.tables import Tables


def newest(articles):
    """Undated first, then newest, then id."""
    return sorted(articles, key=lambda a: (a[1] is not None, -(a[1].timestamp() if a[1] else 0), a[0]))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k, spare", [(3, 2), (7, 0), (4, 10_000)])
def test_first_unread_equals_brute_force(spark, seed, k, spare):
    rng = random.Random(seed)
    day = datetime(2024, 1, 1, 12)
    lists = {}
    for name, n in (("a", 90), ("b", 40), ("c", 1)):
        lists[name] = [(i, rng.choice([None, *[day + timedelta(days=rng.randrange(6), hours=rng.randrange(3)) for _ in range(12)]])) for i in rng.sample(range(100), n)]
    members = {u: rng.choice("abc") for u in range(12)}
    reads = set()
    for u, name in members.items():
        ranked = [a[0] for a in newest(lists[name])]
        # nothing, some, the newest ones, all but the oldest, all, other people's
        reads |= {(u, i) for i in {0: [], 1: rng.sample(ranked, len(ranked) // 3), 2: ranked[:30], 3: ranked[:-2], 4: ranked, 5: range(100, 120)}[u % 6]}
    want = {(u, i, n) for u, name in members.items() for n, i in enumerate([a[0] for a in newest(lists[name]) if (u, a[0]) not in reads][:k], 1)}
    candidates = spark.createDataFrame([(name, *a) for name, rows in lists.items() for a in rows], "_list string, id long, published_at timestamp")
    got, ids = P.first_unread(candidates, spark.createDataFrame(list(members.items()), "user_id long, _list string"),
                              spark.createDataFrame(sorted(reads) or [(0, 0)][:0], "user_id long, id long"), k, spare)
    got = got.collect()
    assert {(r["user_id"], r["id"], r["ordinal"]) for r in got} == want and len(got) == len(want)
    assert {i for _, i, _ in want} <= {r["id"] for r in ids.collect()}


def with_bot(t, spark, share):
    """Reader 0 has read ``share`` of all articles, the newest first."""
    n = int(t.content.count() * share)
    read = t.content.orderBy(*A.newest_first()).limit(n).selectExpr("0L as user_id", "id as content_id", "true as is_read", "false as is_liked", "timestamp'2024-01-15 00:00:00' as interaction_at")
    state = t.interactions.where("user_id <> 0")
    return t.with_(interactions=state.unionByName(read), users=t.users.unionByName(spark.createDataFrame([(0,)], "user_id long")).distinct())


@pytest.fixture(scope="module")
def sample(spark, sf):
    from newsweave.sources import sample as S
    return S.tables(spark, sf)


def test_a_bot_lengthens_no_list(spark, sample, monkeypatch):
    monkeypatch.setattr(P.first_unread, "__defaults__", (20,))
    depth = []
    ranked = P.ranked_head
    monkeypatch.setattr(P, "ranked_head", lambda df, group, order, k, rank="rank": depth.append(k) or ranked(df, group, order, k, rank))
    pages = {}
    for share in (0.0, 0.9, 1.0):
        t = with_bot(sample, spark, share)
        for name, df in (("digest", P.personalized_digest(t, limit=10)), ("batch", P.fast_batch(t, "2024-01-15 12:00:00", limit=10)), ("view", P.fast_view(t, "2024-01-15 12:00:00"))):
            pages[name, share] = sorted((r["user_id"], r["position"], r["id"]) for r in df.select("user_id", "position", "id").collect())
    for name in ("digest", "batch", "view"):
        others = [[r for r in pages[name, share] if r[0] != 0] for share in (0.0, 0.9, 1.0)]
        assert others[0] == others[1] == others[2]
    unread = [a["id"] for a in sample.content.orderBy(*A.newest_first()).select("id").collect()]
    assert [i for u, _, i in pages["digest", 0.9] if u == 0] == unread[int(len(unread) * 0.9):][:10]
    assert [r for r in pages["digest", 1.0] if r[0] == 0] == []
    assert max(depth) <= 30 + 20 < len(unread)


def test_lists_per_set_of_interests(spark, sample):
    """The readers' side of a topic feed meets lists, not topics: no join on the topic of a reader's row."""
    plan = P.topic_feed(sample, "2024-01-15 12:00:00", 24)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Join" in x and "topic" in x]
    sets = P.interest_sets(sample.user_topics)
    lists = P._interest_lists(P._known(sample), sets, 5)
    assert lists.groupBy("_list").count().agg({"count": "max"}).first()[0] <= 5
    assert isinstance(sample, Tables) and sets.select("_list").distinct().count() <= 256
