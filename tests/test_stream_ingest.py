"""The streaming ingest against the batch ingest, a replayed batch, and what a batch reads."""

import glob
import os
import random
from datetime import datetime

import pytest

from newsweave.plans.ingest import ingest
from newsweave.sources.tables import Tables
from newsweave.streaming import ingest as G
from newsweave.streaming import streams as W

NOW = "2024-01-15 12:00:00"
GOOD, BAD = "Python code for cloud software", "A walk in the hills"
ITEMS = "source_id int, source_name string, pos int, link string, title string, summary string, published_at timestamp, image_url string"
CONTENT = "id long, source_id int, title string, summary string, article_url string, published_at timestamp, topic string, image_url string"
ROWS = ["id", "source_id", "title", "summary", "article_url", "topic", "image_url", "classification_method", "ai_confidence_score"]


def world(spark, seed):
    random.seed(seed)
    links = [f"https://n.example.com/{i}" for i in range(25)]
    picture = lambda: random.choice([None, "", f"https://cdn.example.com/{random.randrange(99)}.jpg"])
    items = [(f, f"feed{f}", pos, random.choice(links), random.choice([GOOD, GOOD, BAD, GOOD + " x" * 150, None]), random.choice(["", None, "<b>Cloud</b> software."]), None, picture())
             for f in range(4) for pos in range(random.randrange(6, 12))]
    status = [(u, random.choice([200, 200, 404])) for u in links[:20]]
    stored = [(100 + i, 0, "t", "s", u, datetime(2024, 1, 15, 12), None, picture()) for i, u in enumerate(random.sample(links, 6))]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(status, "url string, status int"), spark.createDataFrame(stored, CONTENT)


def deliver(items, folder, low, high):
    items.where(f"pos >= {low} and pos < {high}").coalesce(1).write.mode("append").parquet(folder)


def run(spark, inbox, content, status, out):
    stream = W.read_files(spark, inbox, spark.createDataFrame([], ITEMS).schema, files_per_batch=1)
    G.ingest_stream(stream, content, status, NOW, out)
    return rows(G.streamed_content(content, out))


def rows(df):
    return sorted((tuple(r[c] for c in ROWS) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_batch_ingest(spark, tmp_path, seed):
    items, status, content = world(spark, seed)
    none = spark.createDataFrame([], "user_id long, content_id long, is_read boolean, is_liked boolean, interaction_at timestamp")
    want = rows(ingest(Tables(None, content, none, None), items, status, NOW, cap=None, rounds=False).content)
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    for low, high in ((0, 3), (3, 4), (4, 20)):
        deliver(items, inbox, low, high)
    assert run(spark, inbox, content, status, out) == want
    # nothing new: nothing changes
    assert run(spark, inbox, content, status, out) == want


def test_replayed_batch_and_what_a_batch_reads(spark, tmp_path):
    items, status, content = world(spark, 7)
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    deliver(items, inbox, 0, 4)
    run(spark, inbox, content, status, out)
    # the rows that the first batch wrote are hidden: a later batch must not need them
    for folder in ("added", "decided", "table"):
        os.rename(f"{out}/{folder}/batch=0", f"{tmp_path}/{folder}")
    deliver(items, inbox, 4, 20)
    stream = W.read_files(spark, inbox, spark.createDataFrame([], ITEMS).schema, files_per_batch=1)
    G.ingest_stream(stream, content, status, NOW, out)
    for folder in ("added", "decided", "table"):
        os.rename(f"{tmp_path}/{folder}", f"{out}/{folder}/batch=0")
    got = rows(G.streamed_content(content, out))
    none = spark.createDataFrame([], "user_id long, content_id long, is_read boolean, is_liked boolean, interaction_at timestamp")
    assert got == rows(ingest(Tables(None, content, none, None), items, status, NOW, cap=None, rounds=False).content)
    # as if the driver was lost before the last batch was committed: it runs again
    last = max(glob.glob(f"{out}/checkpoint/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.rename(last, str(tmp_path / "commit"))
    os.rename(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc", str(tmp_path / "commit.crc"))
    written = os.path.getmtime(f"{out}/added/batch={os.path.basename(last)}/_SUCCESS")
    assert run(spark, inbox, content, status, out) == got
    assert os.path.getmtime(f"{out}/added/batch={os.path.basename(last)}/_SUCCESS") > written


def test_forgotten_urls_are_new(spark, tmp_path):
    _, _, content = world(spark, 3)
    known = content.first()["article_url"]
    status = spark.createDataFrame([(known, 200)], "url string, status int")
    entry = spark.createDataFrame([(1, "f", 0, known, GOOD, "Cloud software.", None, None)], ITEMS)
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    deliver(entry, inbox, 0, 1)
    before = run(spark, inbox, content, status, out)
    assert len(before) == content.count()
    G.forget(content.where(f"article_url = '{known}'"), out)
    deliver(entry.limit(0), inbox, 0, 1)
    run(spark, inbox, content, status, out)
    deliver(entry, inbox, 0, 1)
    assert len(run(spark, inbox, content, status, out)) == len(before) + 1


class Held:
    """A state of a bucket."""

    def __init__(self, value=None):
        self.get = value

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None


def test_one_call_decides_a_bucket():
    """Several URLs in one call, each by its own rows and state."""
    import pandas as pd

    blank = dict.fromkeys(G.COLUMNS)
    row = lambda what, link, pos=0, image=None, eligible=False: {**blank, "what": what, "link": link, "pos": pos, "source_name": "f", "source_id": 1, "image_url": image, "eligible": eligible}
    state = Held((["old", "bare", "gone"], [True, False, True]))
    rows = pd.DataFrame([row("entry", "new", 3, "late"), row("entry", "new", 1, "early"), row("entry", "new", 2, eligible=True), row("entry", "old", 0, "x", True),
                         row("entry", "bare", 2, "second"), row("entry", "bare", 1, "first"), row("entry", "down", 0, "x"), row("gone", "gone"), row("stored", "kept", image="y")])
    out = pd.concat(list(G.decide((0,), iter([rows.iloc[:4], rows.iloc[4:]]), state)))
    assert sorted(zip(out["link"], out["what"], out["pos"], out["image_url"])) == [("bare", "picture", 1, "first"), ("new", "insert", 2, "late")]
    assert dict(zip(*state.get)) == {"old": True, "bare": True, "new": True, "kept": True}
    before = state.get
    assert list(G.decide((0,), iter([rows.iloc[3:4]]), state)) == [] and state.get is before
    assert list(G.decide((0,), iter([pd.DataFrame([row("gone", k) for k in ("old", "bare", "new", "kept")])]), state)) == [] and not state.exists


def test_buckets_stay(spark, tmp_path):
    """Their number follows the stored articles and is that of the first run for good."""
    out = str(tmp_path / "out")
    least = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert G.buckets_of(spark.range(G.BUCKET_URLS * (least + 1)), out) == least + 1
    assert G.buckets_of(spark.range(1), out) == least + 1 and G.buckets_of(spark.range(1), out + "2") == least
