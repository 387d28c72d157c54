import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import ranked as r

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_ranked(items, docs, limit):
    """(item, rank, key, score) by the formula, all documents against all items."""
    counts = [(k, Counter(slow_terms(t))) for k, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (k, c), size in zip(counts, sizes):
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * n // total)))
                    for t in set(slow_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, k is None, k or 0, k))
        out += [(item, i, k, -s) for i, (s, _, _, k) in enumerate(sorted(scores, key=lambda x: x[:3])[:limit], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_treap_holds_every_cell_and_finds_the_best():
    rng = np.random.default_rng(0)
    for _ in range(150):
        height, width = (int(x) for x in rng.integers(1, 50, 2))
        grid = np.where(rng.random((height, width)) < rng.random(), rng.integers(1, 9, (height, width)), 0)
        row, column = np.nonzero(grid)
        levels = r.build(row, column, grid[row, column], r.height_of(height, width))
        treap = r.Treap(levels)
        n = treap.none
        assert sorted(zip(treap.row[:n].tolist(), treap.column[:n].tolist(), treap.value[:n].tolist())) == sorted(zip(row.tolist(), column.tolist(), grid[row, column].tolist()))
        # a node's impact is at least that of each child
        for i, bits in enumerate(levels.bits.tolist()):
            for j in range(bin(bits).count("1")):
                assert treap.value[treap.first[i] + j] <= treap.value[i]
        asked = rng.choice(height, int(rng.integers(1, min(height, 7) + 1)), replace=False)
        weights, limit, floor = rng.integers(1, 5, len(asked)), int(rng.integers(1, 12)), int(rng.integers(0, 25))
        sums = (weights[:, None] * grid[asked]).sum(axis=0)
        want = sorted((-int(s), c) for c, s in enumerate(sums) if s >= max(floor, 1))[:limit]
        columns, scores = treap.best(asked, weights, limit, floor)
        assert list(zip((-scores).tolist(), columns.tolist())) == want


def test_search_opens_few_ranges(monkeypatch):
    """Bounds leave most of a grid unopened: with one outstanding column its path alone is followed."""
    rng = np.random.default_rng(1)
    grid = rng.integers(1, 10, (4, 4096))
    grid[:, 77] = 1000
    row, column = np.nonzero(grid)
    treap = r.Treap(r.build(row, column, grid[row, column], 12))
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            looked.append(np.size(at))
            return np.asarray(self)[at]
    monkeypatch.setattr(r, "AT_ONCE", 4)
    treap.row = treap.row.view(Counted)
    columns, _ = treap.best(np.arange(4), np.ones(4, np.int64), 1)
    assert columns.tolist() == [77] and sum(looked) < 1024


@pytest.mark.parametrize("cells", [1, 40, 10**6])
def test_against_all_pairs(spark, docs_of, odd_texts, cells):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)] + ["É", "日本", "x1"]
    texts = [*odd_texts, *[" ".join(rng.choice(words, int(rng.integers(1, 40)))) for _ in range(60)], *["w1 w2 w3"] * 40]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(8)] + [(8, None), (9, ""), (10, "unheard"), (11, "W1, W2; the"), (0, "w1"), (None, "w2 w2")]
    docs = docs_of(texts).repartition(3).withColumns({"rank": F.lit("clash"), "score": F.lit(1), "term": F.lit(2), "_n": F.lit(1)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"score": F.lit("clash"), "w": F.lit(1)})
    found = r.index(docs, block_cells=cells)
    want = sorted(slow_ranked(items, list(enumerate(texts)), 15), key=str)
    assert rows(r.search(asked, found, 15)) == want
    assert rows(r.search(asked, found, 15, item_chars=100)) == want


def test_repeated_null_and_no_rows(spark, docs_of):
    docs = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (2, "a b c"), (1, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "zz")], "item_id long, text string")
    want = sorted(slow_ranked([(1, "a b"), (2, "zz")], [(5, "a b"), (5, "a b"), (None, "a b"), (2, "a b c"), (1, None)], 50), key=str)
    assert rows(r.ranked(items, docs)) == want
    assert rows(r.ranked(items, docs.limit(0))) == [] and rows(r.ranked(items.limit(0), docs)) == []
    text_ids = docs.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert sorted(r.ranked(items, text_ids).columns) == ["doc_id", "item_id", "rank", "score"] and r.ranked(items, text_ids).count() == 4
