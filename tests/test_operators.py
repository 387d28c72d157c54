"""Brute-force and property checks on small fixtures."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsweave.operators import interactions as I
from newsweave.operators import maintenance as M
from newsweave.operators import ranking as R
from newsweave.plans import feeds as P
from newsweave.plans import ingest as G
from newsweave.sources import sample as S
from newsweave.sources import sinks
from newsweave.sources.feeds import parse_feed_xml

T0 = datetime(2024, 1, 15, 12)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_position_in_group_with_a_hot_group(spark):
    random.seed(1)
    data = [("hot" if random.random() < 0.6 else random.choice("abc"), random.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(8)
    got = {(r.g, r.id): r["rank"] for r in R.position_in_group(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    expected = {}
    for g in {d[0] for d in data}:
        for n, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1:]), 1):
            expected[(g, d[2])] = n
    assert got == expected


def test_sliced_top_k_equals_plain(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 16).select((F.col("id") % 3).alias("g"), "id", F.pmod(F.xxhash64("id"), F.lit(100)).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    sliced = rows(R.top_k_per_group(df, ["g"], order, 1200, spread=7))
    monkeypatch.setattr(R, "GROUP_LIMIT", 10_000)
    assert rows(R.top_k_per_group(df, ["g"], order, 1200)) == sliced


def test_unread_positions_brute_force(spark, monkeypatch):
    random.seed(2)
    reads = [(u, t) for u in range(30) for t in random.sample(range(1, 41), random.randrange(0, 35))]
    reads += [(99, t) for t in range(1, 38)]
    members = spark.createDataFrame([(u,) for u in [*range(30), 99]], "user_id int")
    log = spark.createDataFrame(reads, "user_id int, _turn int")
    expected = sorted((u, t, n) for u in [*range(30), 99] for n, t in enumerate([t for t in range(1, 200) if (u, t) not in set(reads)][:7], 1))
    for limit in (R.HEAD_LIMIT, 0):  # window path, then the distributed sort
        monkeypatch.setattr(P, "HEAD_LIMIT", limit)
        got = P.unread_positions(members, log, ["user_id"], 7, 37).select("user_id", "_turn", "ordinal")
        assert sorted(map(tuple, got.collect())) == expected


def test_digest_on_the_sort_path(spark, sf, monkeypatch):
    t = S.tables(spark, sf)
    usual = rows(P.personalized_digest(t).select("user_id", "position", "id"))
    monkeypatch.setattr(P, "HEAD_LIMIT", 0)
    monkeypatch.setattr(R, "HEAD_LIMIT", 0)
    assert rows(P.personalized_digest(t).select("user_id", "position", "id")) == usual
    one = P.personalized_digest(t, user_id=usual[0][0]).select("user_id", "position", "id")
    assert rows(one) == [r for r in usual if r[0] == usual[0][0]]


def test_fold_is_idempotent_and_keeps_untouched_flags(spark):
    log = spark.createDataFrame([(1, 1, True, None, T0, 1), (1, 1, None, True, T0 + timedelta(1), 2), (1, 2, None, None, T0, 3), (2, 1, False, None, T0, 4)],
                                "user_id long, content_id long, is_read boolean, is_liked boolean, interaction_at timestamp, event_id long")
    once = I.fold_interactions(None, log)
    assert rows(once) == [(1, 1, True, True, T0 + timedelta(1)), (2, 1, False, False, T0)]
    assert rows(I.fold_interactions(once, log)) == rows(once)


def test_reduced_commands_fold_to_the_same_state(spark, sf):
    from newsweave.streaming.streams import last_commands

    log = S.interaction_log(spark, sf)
    parts = [log.where(f"event_id % 3 = {k}") for k in range(3)]
    deltas = last_commands(parts[0]).unionByName(last_commands(parts[1])).unionByName(last_commands(parts[2]))
    assert rows(I.fold_interactions(None, deltas)) == rows(I.fold_interactions(None, log))


def test_round_robin_stops_at_a_round_without_inserts(spark):
    entries = spark.createDataFrame(
        [("a", 1, 0, "u1"), ("b", 2, 0, "u2"), ("c", 3, 0, "u1"), ("a", 1, 1, "u2"), ("b", 2, 1, "u1"), ("c", 3, 1, "u2"), ("a", 1, 2, "u9")],
        "source_name string, source_id int, pos int, link string")
    none = spark.createDataFrame([], "article_url string")
    got = G.round_robin(entries, none)
    assert sorted((r.link, r.source_name, r.pos) for r in got.collect()) == [("u1", "a", 0), ("u2", "b", 0)]


def test_retention_never_drops_liked_or_undated(spark, sf):
    t = S.tables(spark, sf)
    liked = {r.content_id for r in t.interactions.where("is_liked").collect()}
    undated = {r.id for r in t.content.where("published_at is null").collect()}
    everything = {r.id for r in t.content.select("id").collect()}
    left = {r.id for r in M.retention_days(t, S.AS_OF, 1).select("id").collect()}
    assert (liked & everything) <= left and undated <= left and left < everything


def test_retention_decisions(spark):
    counts = spark.createDataFrame([(12, 0, 50), (3, 0, 30), (3, 0, 10), (0, 5, 90)], "fresh_today long, yesterday_count long, total_available long")
    got = [(r.action_taken, r.cutoff) for r in M.retention_rule(counts, S.AS_OF).collect()]
    assert got == [("cleanup_performed", T0 - timedelta(1)), ("conservative_cleanup", T0 - timedelta(2)), ("cleanup_skipped", None), ("cleanup_skipped", None)]


def test_feed_parser(spark):
    rss = ('<rss xmlns:media="m"><channel><item><title>A &amp; B</title><link> https://x/1 </link><pubDate>Mon, 5 Jan 2024 10:00:00 +0100</pubDate>'
           '<description>&lt;p&gt;hi&lt;/p&gt;</description><media:content url="u1"/><media:content url="u2"/><enclosure url="e1"/></item><item><title>C</title></item></channel></rss>')
    atom = '<feed><entry><title>D</title><link rel="self" href="s"/><link href="https://x/2"/><summary>s</summary><updated>2024-01-15T10:00:00Z</updated></entry></feed>'
    docs = spark.createDataFrame([(1, rss), (2, atom), (3, "not xml"), (4, None)], "source_id int, xml string")
    got = {(r.source_id, r.pos): r for r in parse_feed_xml(docs).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    first = got[(1, 0)]
    assert (first.link, first.title, first.summary, first.published_at) == ("https://x/1", "A & B", "<p>hi</p>", datetime(2024, 1, 5, 9))
    assert [m.url for m in first.media_content] == ["u1", "u2"] and first.enclosures[0].href == "e1"
    assert got[(1, 1)].link is None and got[(2, 0)].link == "https://x/2" and got[(2, 0)].published_at == datetime(2024, 1, 15, 10)


def test_replace_partitions_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "trends")
    first = spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-02", "a", 2)], "date string, topic string, n int")
    sinks.replace_partitions(first, path, ["date"])
    sinks.replace_partitions(spark.createDataFrame([("2024-01-02", "a", 9)], "date string, topic string, n int"), path, ["date"])
    assert sorted((str(r.date), r.n) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 9)]


def test_create_tables(spark):
    from newsweave.schemas import TABLES, create_tables

    made = create_tables(spark, "nw_test", ["sources", "topic_trends"])
    assert made == ["nw_test.sources", "nw_test.topic_trends"]
    assert {f.name for f in spark.table("nw_test.topic_trends").schema} == {f.name for f in TABLES["topic_trends"][0]}
    spark.sql("DROP DATABASE nw_test CASCADE")


def test_page_audit_rules(spark):
    from newsweave.operators.audit import page_audit

    page = '<html><body><h2>a</h2><h4>b</h4><img src="x"><input id="q"><a href="#">Here</a><button> </button><table></table></body></html>'
    good = '<html lang="en"><head><meta name="viewport" content="w"></head><main><h1>a</h1><h2>b</h2><img alt="x"><label for="q">q</label><input id="q"></main></html>'
    got = page_audit(spark.createDataFrame([(1, page), (2, good)], "page_id int, html string"))
    assert {(r.page_id, r.rule, r.issues) for r in got.collect()} == {(1, rule, 1) for rule in (
        "no_semantic_element", "first_heading_not_h1", "heading_level_skipped", "image_without_alt", "input_without_label", "button_without_text",
        "vague_link_text", "html_without_lang", "no_viewport", "table_without_header")}


def test_json_lines(spark, sf, tmp_path):
    path = str(tmp_path / "json")
    sinks.write_json(S.sources(spark, sf), path)
    assert spark.read.json(path).count() == S.sources(spark, sf).count()
