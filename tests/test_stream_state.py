"""What streams report and hold: late rows of any number of batches, open sessions from the state."""

import datetime as dt
import time

from newsweave.streaming import streams as W

TIME = dt.datetime(2024, 1, 15, 10)


def inbox_of(spark, batches, schema):
    """One file for each batch, in order."""
    folder = W.new_output(spark, "inbox")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.01)
    return W.read_files(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_late_rows_of_more_batches_than_the_session_keeps(spark):
    schema, late = "article_url string, ts timestamp", [0, 0, 3, 1, 0, 2, 5, 0, 1]
    batches = [[(f"new{i}", TIME + dt.timedelta(days=i))] + [(f"late{i}-{j}", TIME - dt.timedelta(days=90)) for j in range(n)] for i, n in enumerate(late)]
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        out = W.new_output(spark, "dedup")
        table = W.run_to_table(W.dedup_articles(inbox_of(spark, batches, schema), "ts", "2 days"), out)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    rows = W.late_rows(spark, out).collect()
    assert sum(r["rows"] for r in rows) == sum(late) and len({r["batch"] for r in rows}) == len(rows) >= len(late)
    assert spark.read.parquet(table).count() == len(late)


def sessions(rows, idle=dt.timedelta(minutes=30)):
    out, by_user = [], {}
    for u, t in sorted(rows):
        by_user.setdefault(u, []).append(t)
    for u, times in by_user.items():
        start, last, n = times[0], times[0], 0
        for t in times:
            if t >= last + idle:
                out.append((u, start, last + idle, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((u, start, last + idle, n))
    return sorted(out)


def test_closed_and_open_sessions_are_all_sessions(spark):
    batches = [[(u, TIME + dt.timedelta(minutes=40 * b + 11 * k * (u + 1))) for u in range(4) for k in range(4)] for b in range(3)]
    out = W.new_output(spark, "sessions")
    table = W.run_to_table(W.reader_sessions(inbox_of(spark, batches, "user_id long, ts timestamp"), "ts", late="6 hours"), out)
    closed = [tuple(r)[:4] for r in spark.read.parquet(table).select("user_id", "session_start", "session_end", "events").collect()]
    still = W.open_sessions(spark, out)
    plan = still._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()
    assert sorted(closed + [tuple(r) for r in still.collect()]) == sessions([r for b in batches for r in b])
    assert sum(r["rows"] for r in W.late_rows(spark, out).collect()) == 0
