import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import align, queries


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*align.default_tokenizers())


def slow(pair, texts):
    """The contract's definition, occurrence by occurrence."""
    linked, shown, sizes, held = [], [], [], defaultdict(int)
    for t in texts:
        a = pair.a.library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        raw = (" " + t).encode() if t else b""
        if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
            a, b = [], []
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in cuts:
            groups.append(tuple([i for i, e in zip(ids, end) if last < e <= c] for ids, end in zip((a, b), ends)))
            last = c
        mine = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for p in mine:
            held[p] += 1
        linked.append(mine)
        sizes.append((len(a), len(b), len(groups)))
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        shown.append(hashlib.sha256(text.encode()).hexdigest() if a else "")
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(*s, sum(m.values()), sum(n for p, n in m.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in m.items()), d)
            for s, m, d in zip(sizes, linked, shown)]


def rows(df):
    return sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


HARD = ["a▁b", "<s> and </s> <unk> <|endoftext|>", "x" * 3000, "日本語のテキスト😀😀 é́ ß", "\x00\x01 tab\tnew\n\n\nline  two   spaces ", " lead", "ab" * 700 + " " + "é" * 500]


@pytest.mark.parametrize("block_chars", [1, 4000, 10**7])
def test_against_definition(spark, docs_of, odd_texts, pair, block_chars):
    texts = [*odd_texts, *HARD, *HARD[2:4], "the quick brown fox and the lazy dog", "The quick, brown Fox!"]
    docs = docs_of(texts).repartition(3).withColumns({"pair": F.lit("clash"), "n_a": F.lit(1), "block": F.lit(7)})
    got = rows(align.aligned(docs, align.default_tokenizers(), block_chars=block_chars))
    assert got == [(i, *r) for i, r in enumerate(slow(pair, texts))]


def test_query(spark, sf, read, pair):
    docs = sorted((r["doc_id"], r["text"]) for r in read("documents").collect())
    want = slow(pair, [t for _, t in docs])
    assert rows(queries.QUERIES["op13_align"](spark, sf)) == [(k, *w) for (k, _), w in zip(docs, want)]


def test_repeated_and_null_ids(spark, pair):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (1, None)], "doc_id long, text string")
    got = align.aligned(docs, align.default_tokenizers()).collect()
    want = slow(pair, ["one two", "one two", "one", ""])
    assert sorted(map(str, ((r["doc_id"], *list(r)[1:]) for r in got))) == sorted(map(str, zip([1, 1, None, 1], *zip(*want))))
    assert align.aligned(docs.limit(0), align.default_tokenizers()).collect() == []


def test_ranks_are_the_library(pair, read):
    """The short way for Latin-1 texts gives what the file's library gives."""
    rng = np.random.default_rng(3)
    texts = [" " + (r["text"] or "") for r in read("documents").collect()] + [" " + "".join(map(chr, rng.integers(0, 256, 300))) for _ in range(200)]
    texts += [" it's don't WE'LL 12ab  \n\n x\t\xa0y \x85\x1c z", " ", "  ", " <|endoftext|>", " ªº²³¼µß÷×"]
    assert pair.a.ranks is not None and sum(map(align.latin, texts)) > 200
    assert [x.tolist() for x in pair.a.encode(texts)] == [e.ids for e in pair.a.library.encode_batch(texts, add_special_tokens=False)]


def test_galloping():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ends = np.unique(rng.integers(0, 300, 80))
        x = np.sort(rng.integers(0, ends[-1] + 1, 40))
        start = rng.integers(0, len(ends), 40)
        assert align.galloped(x, ends, start).tolist() == np.searchsorted(ends, x).tolist()


def test_large_groups_are_counted_by_ids():
    p, q, doc = np.array([30, 1, 2]), np.array([40, 1, 1]), np.array([0, 0, 1])
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 33), rng.integers(0, 4, 42)
    code, times = align.doc_pairs(a, b, p, q, doc, 100)
    want = Counter()
    for d, (i, n), (j, m) in zip(doc, ((0, 30), (30, 1), (31, 2)), ((0, 40), (40, 1), (41, 1))):
        want.update((int(d) << 32) | int(x * 100 + y) for x in a[i:i + n] for y in b[j:j + m])
    assert dict(zip(code.tolist(), times.tolist())) == want
