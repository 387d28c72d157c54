"""The bucketed reader state and the pages of interests."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsweave.operators import articles as A
from newsweave.operators import state as Z
from newsweave.operators.interactions import fold_interactions
from newsweave.plans import interests as N
from newsweave.sources import sample as S

KEY = ["user_id", "content_id"]


def rows(df):
    return sorted(map(tuple, df.select("user_id", "content_id", "is_read", "is_liked", "interaction_at").collect()))


def exchanges_above_state(df, folder):
    """Exchanges between the scan of the state and the first join above it."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "FileScan" in line and folder in line)
    depth = lambda line: len(re.match(r"^[\s:+\-*|]*(\(\d+\) )?", line).group(0))
    found, level = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < level:
            level = depth(line)
            if "Join" in line:
                return found
            if "Exchange" in line:
                found.append(line)
    raise AssertionError("no join above the state")


@pytest.fixture()
def plain_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("buckets", [1, 5])
def test_fold_merges_into_buckets(spark, sf, tmp_path, plain_joins, buckets):
    log = S.interaction_log(spark, sf)
    half = F.lit("2024-01-16 00:00:00").cast("timestamp")
    first, second = log.where(F.col("interaction_at") < half), log.where(F.col("interaction_at") >= half)
    before = fold_interactions(None, first)
    name = Z.write_state(before, buckets, str(tmp_path / "v1"))
    assert Z.buckets_of(spark, name) == buckets
    after = Z.folded(Z.read_state(spark, name), second, buckets)
    assert exchanges_above_state(after, "/v1") == []
    assert rows(after) == rows(fold_interactions(before, second))
    new = Z.fold_into(spark, name, second, str(tmp_path / "v2"))
    assert rows(Z.read_state(spark, new)) == rows(after) and Z.buckets_of(spark, new) == buckets
    # untouched, unset and late commands
    odd = spark.createDataFrame([(1, 2, None, None, datetime(2030, 1, 1), 1), (1, 3, None, True, datetime(2000, 1, 1), 2), (1, 3, False, None, datetime(1999, 1, 1), 3)],
                                "user_id long, content_id long, is_read boolean, is_liked boolean, interaction_at timestamp, event_id long")
    assert rows(Z.folded(Z.read_state(spark, new), odd)) == rows(fold_interactions(Z.read_state(spark, new), odd))
    Z.drop_state(spark, name)
    assert not spark.catalog.tableExists(name) and spark.read.parquet(str(tmp_path / "v1")).count() == before.count()


def test_joins_leave_the_state_where_it_is(spark, sf, tmp_path, plain_joins):
    state = Z.read_state(spark, Z.write_state(S.interactions(spark, sf), path=str(tmp_path / "v1")))
    page = N.page_of_interests(S.content(spark, sf), S.user_topics(spark, sf), 10).select("user_id", "id")
    for joined in (A.with_state(page, state), A.without_read(page, state)):
        assert exchanges_above_state(joined, "/v1") == []


@pytest.mark.parametrize("depth", [None, 40])
def test_pages_continue(spark, depth):
    rng = random.Random(4)
    day = datetime(2024, 1, 1)
    topics = ["a", "b", "c", None]
    articles = [(i, rng.choice(topics + ["a"] * 4), rng.choice([None] + [day + timedelta(hours=rng.randrange(9)) for _ in range(9)])) for i in range(200)]
    wants = [(u, t) for u in range(9) for t in rng.sample(["a", "b", "c", "nothing"], u % 3 + 1)] + [(0, "a"), (0, "a"), (5, None)]
    content = spark.createDataFrame(articles, "id long, topic string, published_at timestamp")
    sets = N.interest_sets(spark.createDataFrame(wants, "user_id long, topic string"))
    runs, cursor, got = N.topic_runs(content, depth), None, {}
    for _ in range(4):
        page, cursor = N.interest_page(runs, sets, 10, cursor)
        found = page.collect()
        for r in sorted(found, key=lambda r: r["position"]):
            got.setdefault(r["user_id"], []).append(r["id"])
        per_reader = [sum(r["user_id"] == u for r in found) for u in range(9)]
        assert max(per_reader) <= 10
    for u in {u for u, _ in wants}:
        mine = [a for a in articles if (u, a[1]) in wants and a[1]]
        want = [a[0] for a in sorted(mine, key=lambda a: (a[2] is not None, -(a[2].timestamp() if a[2] else 0), a[0]))][:40]
        assert got.get(u, []) == want


def test_all_articles_of_interests(spark):
    """More than three pages for every reader, of all dates, numbered; repeated interests count once."""
    rng = random.Random(5)
    day = datetime(2024, 1, 1)
    articles = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, day, day + timedelta(days=rng.randrange(99))])) for i in range(400)]
    wants = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "nothing"), (5, None)]
    content = spark.createDataFrame(articles, "id long, topic string, published_at timestamp")
    got = {}
    for r in N.articles_of_interests(content, spark.createDataFrame(wants, "user_id long, topic string")).collect():
        got.setdefault(r["user_id"], []).append((r["position"], r["id"], r["topic"], r["published_at"]))
    assert set(got) == {1, 2, 3} and min(map(len, got.values())) > 60
    for u, found in got.items():
        mine = sorted((a for a in articles if (u, a[1]) in wants), key=lambda a: (a[2] is not None, -(a[2].timestamp() if a[2] else 0), a[0]))
        assert sorted(found) == [(n, *a) for n, a in enumerate(mine, 1)]


def test_registered_interest_joins_are_whole(spark, tmp_path):
    """As many rows as articles and interests have pairs."""
    from newsweave.catalog import QUERIES

    spark.range(600).selectExpr("id as doc_id", "'A title. Text.' as text", "'en' as lang", "'src1' as source", "15L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3000).selectExpr("id as event_id", "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) as ts", "id % 4 as user_id", "'view' as event_type",
                                 "1.0D as value", "cast(null as string) as props").write.parquet(f"{tmp_path}/events.parquet")
    content, wanted = S.content(spark, str(tmp_path)), S.user_topics(spark, str(tmp_path))
    pairs = content.join(wanted, "topic").count()
    assert pairs > 60 * wanted.select("user_id").distinct().count()
    read = S.interactions(spark, str(tmp_path)).where("is_read").join(content.withColumnRenamed("id", "content_id"), "content_id").join(wanted, ["user_id", "topic"]).count()
    for name, n in (("join_user_interests", pairs), ("join_article_user_state", pairs), ("anti_read_by_user", pairs - read)):
        assert QUERIES[name](spark, str(tmp_path)).count() == n


def wanted_pairs(articles, wants):
    return sorted(((u, a[0]) for u in {u for u, _ in wants} for a in articles if (u, a[1]) in wants and a[1]), key=str)


def test_whole_lists_meet_readers_in_pieces(spark, monkeypatch):
    """As many tasks as the pairs ask for, though few rows are moved; each pair once, over the edges of pieces too."""
    monkeypatch.setattr(N, "ARTICLES", 7)
    monkeypatch.setattr(N, "READERS", 3)
    monkeypatch.setattr(N, "TASK_PAIRS", 100)
    articles = [(i, "ab"[i % 3 > 1], datetime(2024, 1, 1 + i % 20)) for i in range(90)] + [(3, "a", None), (3, "a", None)]
    wants = [(u, t) for u in range(20) for t in "ab"[: 1 + u % 2]] + [(77, "b"), (None, "a")]
    content, interests = spark.createDataFrame(articles, "id long, topic string, published_at timestamp"), spark.createDataFrame(wants, "user_id long, topic string")
    found = N.articles_of_interests(content, interests)
    want = wanted_pairs(articles, wants)
    assert found.rdd.getNumPartitions() >= len(want) // 100 > 8
    assert sorted(((r["user_id"], r["id"]) for r in found.collect()), key=str) == want


def test_pairs_split_by_state(spark, monkeypatch):
    """Rows that the state knows and all others, against sets; repeated and null ids, a null reader, and a reader who has seen all."""
    monkeypatch.setattr(N, "ARTICLES", 7)
    monkeypatch.setattr(N, "READERS", 3)
    rng = random.Random(8)
    articles = [(i, rng.choice("aab"), datetime(2024, 1, 1 + i % 20)) for i in range(80)] + [(3, "a", None), (4, "b", None), (None, "a", None), (5, None, None)]
    wants = [(u, t) for u in range(9) for t in "ab"[: 1 + u % 2]] + [(1, "a"), (None, "a")]
    keys = {(u, rng.randrange(99)) for u in range(9) for _ in range(9)} | {(7, i) for i in range(80)} | {(None, 3), (2, None), (500, 1)}
    state = spark.createDataFrame([(u, c, rng.random() < 0.5, rng.random() < 0.5, datetime(2024, 2, 1)) for u, c in keys], "user_id long, content_id long, is_read boolean, is_liked boolean, interaction_at timestamp")
    content, interests = spark.createDataFrame(articles, "id long, topic string, published_at timestamp"), spark.createDataFrame(wants, "user_id long, topic string")
    known, others = N.split_by_state(content, interests, state)
    stored = {(u, c) for u, c in keys if u is not None and c is not None}
    want = wanted_pairs(articles, wants)
    assert sorted(map(tuple, known.collect()), key=str) == [p for p in want if p in stored]
    assert sorted(map(tuple, others.collect()), key=str) == [p for p in want if p not in stored]
    # with the operators, as if all pairs had met the state
    pages = N.articles_of_interests(content, interests).select("user_id", "id")
    whole = lambda df: sorted(df.select(sorted(df.columns)).collect(), key=str)
    assert whole(A.with_state(known, state).unionByName(A.never_seen(others))) == whole(A.with_state(pages, state))
    assert whole(A.without_read(known, state).unionByName(others)) == whole(A.without_read(pages, state))
    assert A.never_seen(others).select(sorted(A.never_seen(others).columns)).dtypes == A.with_state(known, state).select(sorted(A.with_state(known, state).columns)).dtypes


@pytest.mark.parametrize("name", ["join_user_interests", "join_article_user_state", "anti_read_by_user"])
def test_pairs_are_not_moved(spark, sf, name, plain_joins):
    """Nothing is exchanged above the join that makes the pairs."""
    from newsweave.catalog import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"^[\s:+\-*|]*(\(\d+\) )?", line).group(0))
    at = next(i for i, line in enumerate(plan) if "Join" in line and "_part" in line and "_crew" in line)
    level, above = depth(plan[at]), []
    for line in reversed(plan[:at]):
        if line.strip() and depth(line) < level:
            level = depth(line)
            above.append(line)
    assert above and not [line for line in above if "Exchange" in line]
