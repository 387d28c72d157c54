"""Plan shape: what must reach the scan, and what must not appear."""

from newsweave.operators import trends as T
from newsweave.plans import feeds as P
from newsweave.sources import sample as S


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_no_cross_join_in_feeds(spark, sf):
    t = S.tables(spark, sf)
    for df in (P.personalized_digest(t), P.fast_view(t, S.AS_OF), P.fast_batch(t, S.AS_OF), P.user_top_articles(t, S.AS_OF), P.home_sections(t)):
        assert "CartesianProduct" not in plan(df) and "NestedLoopJoin" not in plan(df)


def test_columns_are_pruned(spark, sf):
    text = plan(T.trending_topics_counts(S.tables(spark, sf), S.AS_OF))
    assert "ReadSchema: struct<doc_id:bigint,source" not in text.replace("text:string", "")
    assert "text:string" not in text


def test_time_filter_reaches_the_scan(spark, tmp_path, sf):
    path = str(tmp_path / "content")
    S.content(spark, sf).write.parquet(path)
    t = S.tables(spark, sf).with_(content=spark.read.parquet(path))
    assert "GreaterThanOrEqual(published_at" in plan(T.trending_topics(t, S.AS_OF))


def test_top_k_is_cut_below_the_shuffle(spark, sf, monkeypatch):
    """Every ranking that a topic feed writes on its way is cut in the map tasks; what is left ranks nothing."""
    written = []
    cut = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: written.append(plan(df)) or cut(df))
    feed = plan(P.topic_feed(S.tables(spark, sf), S.AS_OF, 24))
    ranked = [p for p in written if "Window" in p]
    assert ranked and all(p.count("WindowGroupLimit") >= 2 for p in ranked) and "Window" not in feed


def test_no_text_is_moved_with_a_reader(spark, sf):
    """Exchanges on a reader's id carry ids, places and flags only; articles are joined by their own id."""
    import re

    from newsweave.plans import feeds as P
    from newsweave.sources import sample as S

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = S.tables(spark, sf)
        for df in (P.personalized_digest(t), P.topic_feed(t, S.AS_OF, 168), P.fast_view(t, S.AS_OF), P.recommended_section(t)):
            plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            moved = re.findall(r"\) Exchange\n(?:Input[^\n]*: )(\[[^\n]*\])\nArguments: hashpartitioning\(user_id", plan)
            assert moved and not any("summary" in columns for columns in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
