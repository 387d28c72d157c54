"""The feed source: one reader for batch and stream, no document twice."""

import os

from newsweave.sources import feed_source as X
from newsweave.streaming import streams as W


def put(root, feed, number, text, name="part-0.txt"):
    folder = f"{root}/source_id={feed}/number={number}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def got(df):
    return sorted((r["source_id"], r["number"], r["xml"]) for r in df.select("source_id", "number", "xml").collect())


def test_batch_and_stream_are_one_reader(spark, tmp_path):
    root, out = str(tmp_path / "feeds"), str(tmp_path / "out")
    want = []
    for feed in (3, 1, 12):
        for number in (0, 2, 10, 9):
            put(root, feed, number, f"<rss>ä {feed}/{number}</rss>")
            want.append((feed, number, f"<rss>ä {feed}/{number}</rss>"))
    put(root, 3, 0, "no", "_SUCCESS")
    put(root, 3, 0, "no", ".part.crc")
    os.makedirs(f"{root}/other/number=1")
    assert got(X.feed_documents(spark, root, documents_per_task=3)) == sorted(want)

    def run():
        W.run_to_table(X.feed_documents(spark, root, stream=True), out)
        return spark.read.schema(X.SCHEMA + ", batch long").parquet(f"{out}/table")
    assert got(run()) == sorted(want)
    # a restart: documents below the offset are not read again, a late number below it neither, new feeds and numbers are
    put(root, 1, 5, "late")
    put(root, 1, 11, "next")
    put(root, 7, 0, "new feed")
    more = [(1, 11, "next"), (7, 0, "new feed")]
    table = run()
    assert got(table) == sorted(want + more)
    assert got(table.where("batch > 0")) == more
    assert got(run()) == sorted(want + more)


def test_partitions(tmp_path):
    root = str(tmp_path)
    for number in range(25):
        put(root, 1, number, "x")
    put(root, 2, 4, "y")
    folder = X.Folder({"root": root, "documents_per_task": "10"})
    assert [(r.feed, len(r.numbers)) for r in folder.runs({})] == [(1, 10), (1, 10), (1, 5), (2, 1)]
    assert [(r.feed, r.numbers) for r in folder.runs({"1": 21, "2": 4}, {"1": 23, "2": 4})] == [(1, (22, 23))]
    assert folder.ends() == {"1": 24, "2": 4}
    missing = X.Folder({"root": f"{root}/nothing"})
    assert missing.runs({}) == [] and missing.ends() == {}


def test_a_backlog_makes_longer_runs(tmp_path, monkeypatch):
    """No more tasks for more documents: runs grow beyond ``documents_per_task``."""
    monkeypatch.setattr(X, "MAX_RUNS", 5, raising=False)
    for feed in (1, 2):
        for number in range(30):
            put(str(tmp_path), feed, number, "x")
    runs = X.Folder({"root": str(tmp_path), "documents_per_task": "2"}).runs({})
    assert [(r.feed, len(r.numbers)) for r in runs] == [(1, 12), (1, 12), (1, 6), (2, 12), (2, 12), (2, 6)]
    assert [n for r in runs if r.feed == 2 for n in r.numbers] == list(range(30))
