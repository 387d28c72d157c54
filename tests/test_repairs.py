"""Cases that the given tables do not hold: topics outside the fixed ones, long unread lists, readers and columns that are new."""

import datetime as dt

from pyspark.sql import functions as F

from newsweave.operators import maintenance as M
from newsweave.plans import feeds as P
from newsweave.plans import ingest as G
from newsweave.sources.tables import Tables

NOW = "2024-01-15 12:00:00"
TIME = dt.datetime(2024, 1, 15, 10, 0, 0)


def small_tables(spark, n=60):
    sources = spark.createDataFrame([(1, "one", "https://one.example.com")], "id int, source_name string, feed_url string")
    content = spark.createDataFrame([(i, 1, f"t{i}", "s", f"https://x.example.com/{i}", TIME - dt.timedelta(minutes=i), "Custom" if i % 2 else "AI & ML", None) for i in range(n)],
                                    "id long, source_id int, title string, summary string, article_url string, published_at timestamp, topic string, image_url string")
    state = spark.createDataFrame([(1, i, True, False, TIME) for i in range(10)], "user_id long, content_id long, is_read boolean, is_liked boolean, interaction_at timestamp")
    topics = spark.createDataFrame([(1, "Custom"), (2, "Custom"), (2, "AI & ML"), (3, "Nothing has it")], "user_id long, topic string")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    return Tables(sources, content, state, topics, users)


def test_fast_batch_with_any_topic_and_no_cap(spark):
    t = small_tables(spark)
    got = P.fast_batch(t, NOW, limit=3).collect()
    totals = {r["user_id"]: r["total_unread"] for r in got}
    assert totals == {1: 25, 2: 60, 4: 60}
    assert [r["id"] for r in sorted(got, key=lambda r: (r["user_id"], r["position"])) if r["user_id"] == 1] == [11, 13, 15]
    assert {r["user_id"]: r["total_unread"] for r in P.fast_batch(t, NOW, limit=3, cap=8).collect()} == {1: 3, 2: 8, 4: 8}
    page = P.fast_batch(t, NOW, offset=20, limit=10).where("user_id = 1").orderBy("position").collect()
    assert [r["id"] for r in page] == [51, 53, 55, 57, 59]


def test_rounds_end_at_the_first_empty_one(spark):
    def stop(places):
        return G.last_round(spark.createDataFrame([(p,) for p in places], "pos int")).first()["stop"]
    assert [stop([]), stop([1, 2]), stop([0, 1, 1, 3]), stop(range(40))] == [0, 0, 2, 40]


def test_sync_keeps_columns(spark):
    now = spark.createDataFrame([(7, "a", "u1", TIME, "x"), (9, "b", "u2", TIME, "y")], "id int, source_name string, feed_url string, created_at timestamp, category string")
    target = spark.createDataFrame([("b2", "u2"), ("z", "u9"), ("c", "u3"), ("c0", "u3")], "name string, url string")
    got = {r["feed_url"]: r for r in M.sync_sources(now, target, NOW).collect()}
    assert {u: (r["id"], r["source_name"], r["category"]) for u, r in got.items()} == {"u2": (9, "b", "y"), "u3": (10, "c", None), "u9": (11, "z", None)}
    assert got["u2"]["created_at"] == TIME and got["u3"]["created_at"] == dt.datetime(2024, 1, 15, 12)


def test_preferences_of_a_new_reader(spark):
    prefs = spark.createDataFrame([(1, "tldr", "short", TIME)], "user_id long, summary_type string, summary_length string, updated_at timestamp")
    patch = spark.createDataFrame([(2, "key-points", "long"), (3, "key-points", "endless")], "user_id long, summary_type string, summary_length string")
    got = {r["user_id"]: (r["summary_type"], r["summary_length"], r["updated_at"]) for r in M.set_preferences(prefs, patch, NOW).collect()}
    assert got == {1: ("tldr", "short", TIME), 2: ("key-points", "long", dt.datetime(2024, 1, 15, 12))}


def test_counts_only_what_is_recent(spark):
    from newsweave.operators import trends as T

    t = small_tables(spark)
    plan = T.trending_topics_counts(t, NOW)._jdf.queryExecution().optimizedPlan().toString()
    counted = plan.index("Join LeftOuter")
    assert "Join LeftSemi" in plan[counted:]
    assert {r["topic"]: r["interaction_count"] for r in T.trending_topics_counts(t, NOW).collect()} == {"AI & ML": 5, "Custom": 5}


def test_job_status_has_topics(spark):
    from newsweave.plans.dashboard import job_status

    assert [(r["topic"], r["count"]) for r in job_status(small_tables(spark), NOW).first()["top_topics"]] == [("AI & ML", 30), ("Custom", 30)]


def test_hosts_by_last_label(spark):
    from newsweave.functions.urls import blocked_hosts

    pages = spark.createDataFrame([("http://a.b.com/x",), ("http://c.org/",), ("http://b.com/",), (None,)], "url string")
    def hit(*hosts):
        return sorted(r["url"] for r in blocked_hosts(pages, spark.createDataFrame([(h,) for h in hosts], "host string")).collect())
    assert hit("com") == ["http://a.b.com/x", "http://b.com/"]
    assert hit("A.b.com", "org") == ["http://a.b.com/x", "http://c.org/"]
    assert hit("nothing.com") == []


def test_ingest_keeps_columns_of_the_table(spark):
    t = small_tables(spark, 4)
    t = t.with_(content=t.content.withColumns({"published_on": F.to_date("published_at"), "note": F.lit("kept")}))
    entries = spark.createDataFrame([(1, "one", 0, "https://x.example.com/new", "Python code review for cloud software", "Docker and Kubernetes on Linux servers", TIME, None)],
                                    "source_id int, source_name string, pos int, link string, title string, summary string, published_at timestamp, image_url string")
    up = spark.createDataFrame([("https://x.example.com/new", 200)], "url string, status int")
    rows = {r["article_url"]: r for r in G.ingest(t, entries, up, NOW, cap=None).content.collect()}
    assert len(rows) == 5 and rows["https://x.example.com/new"]["published_on"] == dt.date(2024, 1, 15)
    assert rows["https://x.example.com/1"]["note"] == "kept" and rows["https://x.example.com/new"]["note"] is None
    assert rows["https://x.example.com/new"]["classification_method"]


def test_feed_entries_choose_text_and_picture(spark):
    rows = [("a", "Title A", "<p>short</p>", [("",), ("<p>Alpha</p><p>Beta AT&amp;T</p>",)], [("https://i.example.com/m.jpg",)]),
            ("b", "Title B", '<b>Only</b> summary<img src="https://i.example.com/h.jpg">', None, None), ("c", "Title C", None, None, None), ("d", "Title D", "", [], [])]
    kinds = "link string, title string, summary string, content array<struct<value:string>>, media_content array<struct<url:string>>"
    parsed = spark.createDataFrame(rows, kinds).withColumns({"media_thumbnail": F.col("media_content"), "enclosures": F.lit(None).cast("array<struct<href:string>>")})
    got = {r["link"]: (r["summary"], r["image_url"]) for r in G.feed_entries(parsed).collect()}
    assert got == {"a": ("Alpha Beta AT&T", "https://i.example.com/m.jpg"), "b": ("Only summary", "https://i.example.com/h.jpg"),
                   "c": ("Title C", None), "d": ("Title D", None)}


def test_a_failed_run_is_logged(spark):
    t = small_tables(spark, 3)

    def broken():
        raise ValueError("feed store is away\nmore")
    assert tuple(G.logged_run(spark, broken, NOW).first())[:3] == (False, None, "ValueError: feed store is away")
    entries = spark.createDataFrame([], "source_id int, source_name string, pos int, link string, title string, summary string, published_at timestamp, image_url string")
    up = spark.createDataFrame([], "url string, status int")
    assert tuple(G.logged_run(spark, lambda: G.ingest(t, entries, up, NOW), NOW).first())[:3] == (True, 0, None)


def test_text_of_odd_markup(one):
    from newsweave.functions import html as H

    pages = ["a<script>x</script >b<style>c", "<p title='a > b'>t</p>", "1 < 2 && 3 > 2", "x<!-- a > b -->y<!doctype html><?xml?>z", "&lt;b&gt; &copy; &#65;&#x42;", "<p>  n </p>", "<SCRIPT>a</SCRIPT>q"]
    assert one(H.html_to_text(F.col("h")), h=pages) == ["a b", "t", "1 < 2 && 3 > 2", "x y z", "<b> © AB", "n", "q"]
