"""Deletes in place: right rows, untouched files."""

import glob
import os
from datetime import datetime

from pyspark.sql import functions as F

from newsweave.operators import maintenance as M
from newsweave.sources import rewrite as R
from newsweave.sources import sample as S
from newsweave.sources.sinks import replace_partitions


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/*/*.parquet")}


def table(spark, path, rows):
    df = spark.createDataFrame(rows, "id long, text string, at timestamp").withColumn("published_on", F.to_date("at"))
    replace_partitions(df, path, ["published_on"])
    return df


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"t{i}", datetime(2024, 1, 1 + i % 5, 3) if i % 6 else None) for i in range(60)]
    df = table(spark, path, rows)
    before = files(path)
    gone = spark.createDataFrame([(i,) for i in (1, 1, 6, 31, 31, 999)], "id long")  # the second day and the undated ones
    parts = R.delete_rows(spark, path, df.schema, gone, ["id"], ["published_on"])
    assert {str(p[0]) for p in parts} == {"2024-01-02", "None"}
    after = files(path)
    folder = lambda names: {n.split("/")[0] for n in names}
    assert folder(before - after) == folder(after - before) == {"published_on=2024-01-02", "published_on=__HIVE_DEFAULT_PARTITION__"}
    left = {r["id"]: r["text"] for r in spark.read.schema(df.schema).parquet(path).collect()}
    assert left == {i: t for i, t, _ in rows if i not in (1, 6, 31)}
    # nothing left to delete: nothing is written
    assert R.delete_rows(spark, path, df.schema, gone, ["id"], ["published_on"]) == [] and files(path) == after


def test_a_partition_that_loses_all_rows_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark, path, [(i, "x", datetime(2024, 1, 1 + i % 2)) for i in range(10)] + [(100, "u", None)])
    R.delete_rows(spark, path, df.schema, spark.createDataFrame([(i,) for i in (0, 2, 4, 6, 8, 100)], "id long"), ["id"], ["published_on"])
    assert [os.path.basename(p) for p in glob.glob(f"{path}/published_on=*")] == ["published_on=2024-01-02"]
    assert sorted(r["id"] for r in spark.read.schema(df.schema).parquet(path).collect()) == [1, 3, 5, 7, 9]


def test_retention_in_place(spark, sf, tmp_path):
    t, path = S.tables(spark, sf), str(tmp_path / "content")
    dated = t.content.withColumn("published_on", F.to_date("published_at"))
    replace_partitions(dated, path, ["published_on"])
    before = files(path)
    view = t.with_(content=spark.read.schema(dated.schema).parquet(path))
    cutoff = F.lit("2024-01-08 05:00:00").cast("timestamp")
    parts = M.retention_in_place(view, path, dated.schema, cutoff)
    assert parts and max(p[0] for p in parts).isoformat() <= "2024-01-08"
    kept = spark.read.schema(dated.schema).parquet(path)
    want = M._drop_old(t, cutoff).select("id", "summary", "published_at")
    assert sorted(map(tuple, kept.select("id", "summary", "published_at").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    later = {f for f in before if "=2024" in f and f.split("=")[1][:10] > "2024-01-08"}
    assert later and later <= files(path)
    # without a cutoff nothing goes
    now = files(path)
    assert M.retention_in_place(t.with_(content=kept), path, dated.schema, F.lit(None).cast("timestamp")) == [] and files(path) == now
