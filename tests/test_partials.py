"""Hourly partial counts: any split of the commands adds up to the same windows."""

import pytest
from pyspark.sql import functions as F

from newsweave.operators import partials as W
from newsweave.operators import trends as T
from newsweave.operators.interactions import fold_interactions
from newsweave.plans.dashboard import dashboard_rows
from newsweave.session import cut_lineage
from newsweave.sources import sample as S

AS_OF = S.AS_OF


@pytest.fixture(scope="module")
def t(spark, sf):
    t = S.tables(spark, sf)
    return t.with_(content=cut_lineage(t.content), interactions=cut_lineage(t.interactions))


def counts(rows):
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_batches_add_up(spark, sf, t, tmp_path, parts):
    log = S.interaction_log(spark, sf)
    path, state = str(tmp_path / "counts"), None
    W.write_batch(W.article_rows(t.content), path, 0)
    edges = log.select(F.expr(f"percentile_approx(interaction_at, array({', '.join(str((i + 1) / parts) for i in range(parts))}), 10000)").alias("q")).first()["q"]
    low = None
    for i, high in enumerate(edges, 1):
        part = log.where(F.col("interaction_at") <= F.lit(high)) if low is None else log.where((F.col("interaction_at") > F.lit(low)) & (F.col("interaction_at") <= F.lit(high)))
        low = high
        keys = part.select("user_id", "content_id").distinct()
        before = None if state is None else state.join(keys, ["user_id", "content_id"], "left_semi")
        after = cut_lineage(fold_interactions(before, part))
        for _ in range(2):  # a batch that is written again replaces itself
            W.write_batch(W.state_rows(after, t.content, before), path, i)
        state = cut_lineage(after if state is None else state.join(keys, ["user_id", "content_id"], "left_anti").unionByName(after))
    rows = W.read_counts(spark, path)
    want = counts(T.topic_trends_daily(t).select("date", "topic", "article_count", "view_count", "interaction_count"))
    assert counts(W.daily_trends(rows)) == want
    assert counts(W.daily_trends(W.merged(W.merged(rows)))) == want
    since = F.lit("2024-01-14 09:30:00").cast("timestamp")
    direct = T.recent_counts(t, "2024-01-15 09:30:00", 24).select("id", "interaction_count", "view_count")
    assert counts(W.by_article(rows, since).select("id", "interaction_count", "view_count")) == counts(direct)
    assert counts(dashboard_rows(t, AS_OF, rows)) == counts(dashboard_rows(t, AS_OF))


def scans(df, of):
    return df._jdf.queryExecution().optimizedPlan().toString().count(of)


def test_counts_read_the_state_once_or_not_at_all(spark, sf, tmp_path):
    t = S.tables(spark, sf)
    W.write_batch(W.article_rows(t.content), str(tmp_path / "counts"), 0)
    rows = W.read_counts(spark, str(tmp_path / "counts"))
    # the state is a fold of the log, which shows as max_by
    assert scans(T.recent_counts(t, AS_OF), "max_by") > scans(T.recent_counts(t, AS_OF, partials=rows), "max_by") == 0
    plan = W.by_article(rows, F.lit(AS_OF).cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(published_on" in plan
