"""Pages from range partitions."""

import glob
import os
import random
import re
from datetime import datetime, timedelta

import pytest

from newsweave.operators import paging as G


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None] + [datetime(2024, 1, 1) + timedelta(hours=rng.randrange(20)) for _ in range(5)])) for i in range(1000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, published_at timestamp")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, -(r[1].timestamp() if r[1] else 0), r[0]))


def test_pages_at_any_offset(articles):
    rows, df = articles
    index, want = G.page_index(df, 70), ordered(rows)
    assert sum(index.rows) == 1000 and len(index.rows) == 15 and max(index.rows) < 300
    for offset in (0, 1, 69, 70, 333, 990, 999, 1000, 5000):
        for limit in (1, 30, 150):
            assert [tuple(r) for r in index.page(limit, offset).collect()] == want[offset:offset + limit]


def test_a_page_reads_only_its_partitions(spark, articles, tmp_path):
    rows, df = articles
    index = G.page_index(df, 70, str(tmp_path / "pages"))
    parts, _ = index.parts_of(20, 900)
    assert len(parts) <= 2
    for folder in glob.glob(f"{tmp_path}/pages/part=*"):
        if int(folder.rsplit("=", 1)[1]) not in parts:
            for f in glob.glob(f"{folder}/*.parquet"):
                os.truncate(f, 0)
    assert [tuple(r) for r in index.page(20, 900).collect()] == ordered(rows)[900:920]
    assert re.search(r"PartitionFilters: \[[^\]]*part#", index.page(20, 900)._jdf.queryExecution().executedPlan().toString())


def test_seek(articles):
    rows, df = articles
    want, last, got = ordered(rows), None, []
    for _ in range(6):
        page = [tuple(r) for r in G.seek_page(df, 60, last).collect()]
        got += page
        last = (page[-1][1], page[-1][0])
    assert got == want[:360]


def test_empty(spark, articles):
    index = G.page_index(articles[1].limit(0))
    assert index.page(10).collect() == [] and index.page(10, 100).collect() == []


def test_parts_are_bounded(articles, monkeypatch):
    """Pages of few rows do not cut a large table into ever more partitions."""
    rows, df = articles
    monkeypatch.setattr(G, "MAX_PARTS", 12, raising=False)
    index, want = G.page_index(df, 5), ordered(rows)
    assert len(index.rows) == 12 and sum(index.rows) == 1000
    assert [tuple(r) for r in index.page(30, 500).collect()] == want[500:530]
