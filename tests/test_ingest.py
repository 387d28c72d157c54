"""The relational ingest against a step-by-step run of the same rules on small random feeds."""

import random
from datetime import datetime

import pytest

from newsweave.plans.ingest import ingest
from newsweave.sources.tables import Tables

NOW = datetime(2024, 1, 15, 12)
GOOD, BAD = "Python code for cloud software", "A walk in the hills"


def step_by_step(stored, feeds, status):
    """stored: {url: image}; feeds: [(name, id, [entry..])] by name. Returns (final images, inserted urls in order)."""
    table, inserted, turn = dict(stored), [], 0
    while True:
        added = False
        for _, _, entries in feeds:
            if turn >= len(entries):
                continue
            e = entries[turn]
            if e["link"] in table:
                table[e["link"]] = table[e["link"]] or e["image"]
            elif status.get(e["link"]) == 200 and e["title"].startswith(GOOD) and len(e["title"]) <= 255:
                table[e["link"]] = e["image"]
                inserted.append(e["link"])
                added = True
        if not added:
            return table, inserted
        turn += 1


@pytest.mark.parametrize("seed", range(4))
def test_ingest_equals_step_by_step(spark, seed):
    random.seed(seed)
    links = [f"https://n.example.com/{i}" for i in range(14)]
    picture = lambda: random.choice([None, None, f"https://cdn.example.com/{random.randrange(99)}.jpg"])
    feeds = []
    for f in range(4):
        entries = [{"link": random.choice(links), "title": random.choice([GOOD, GOOD, BAD, GOOD + " x" * 150]), "image": picture()}
                   for _ in range(random.randrange(3, 11))]
        feeds.append((f"feed{f}", f, entries))
    status = {u: random.choice([200, 200, 404]) for u in links[:12]}
    stored = {u: picture() for u in random.sample(links, 3)}
    expected, inserted = step_by_step(stored, feeds, status)

    content = spark.createDataFrame(
        [(100 + i, 0, "t", "s", u, NOW, None, img) for i, (u, img) in enumerate(stored.items())],
        "id long, source_id int, title string, summary string, article_url string, published_at timestamp, topic string, image_url string")
    none = spark.createDataFrame([], "user_id long, content_id long, is_read boolean, is_liked boolean, interaction_at timestamp")
    t = Tables(None, content, none, None)
    items = spark.createDataFrame(
        [(fid, name, pos, e["link"], e["title"], "", None, e["image"]) for name, fid, entries in feeds for pos, e in enumerate(entries)],
        "source_id int, source_name string, pos int, link string, title string, summary string, published_at timestamp, image_url string")
    run = ingest(t, items, spark.createDataFrame(list(status.items()), "url string, status int"), "2024-01-15 12:00:00")
    assert [r.article_url for r in run.added.orderBy("id").collect()] == inserted
    assert {r.article_url: r.image_url for r in run.content.collect()} == expected
    assert run.run.first().articles_added == len(inserted)
    assert run.content.select("id").distinct().count() == len(expected)


def test_entries_are_classified_once(spark):
    """the pictures that entries offer are read from the entries that were classified, not made once more from the feeds."""
    schema = "source_id int, source_name string, pos int, link string, title string, summary string, published_at timestamp, image_url string"
    rows = [(1, "a", i, f"https://n.example.com/{i}", f"{GOOD} {i}", "", NOW, f"https://cdn.example.com/{i}.jpg") for i in range(3)]
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b
    items = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    content = spark.createDataFrame([], "id long, source_id int, title string, summary string, article_url string, published_at timestamp, topic string, image_url string")
    none = spark.createDataFrame([], "user_id long, content_id long, is_read boolean, is_liked boolean, interaction_at timestamp")
    run = ingest(Tables(None, content, none, None), items, spark.createDataFrame([(r[3], 200) for r in rows], "url string, status int"), "2024-01-15 12:00:00")
    assert {r.article_url: r.image_url for r in run.content.collect()} == {r[3]: r[7] for r in rows}
    assert passed.value == len(rows)
