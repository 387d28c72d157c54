import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsweave.llm import queries, simhash


def slow_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, distance=2):
    """Smallest id reachable by links, for (id, fingerprint) pairs."""
    root = {k: k for k, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, p), (b, q) in itertools.combinations(prints, 2):
        if (p ^ q).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in prints}


def test_fingerprint(odd_texts):
    for t in [*odd_texts, "one", "one two", "A b C d", "x y z w " * 40]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_query_against_all_pairs(spark, sf, read):
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in read("documents").collect()]
    want = slow_groups(prints)
    got = queries.QUERIES["op2_simhash"](spark, sf).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(k, f"{p:016x}", want[k]) for k, p in prints}
    assert len(got) == len(prints)


def test_index_finds_all_near_codes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 16, 17, 900):
        base = rng.integers(0, 2**63, max(1, n // 30), dtype=np.uint64)
        codes = base[rng.integers(0, len(base), n)]
        for _ in range(2):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        codes = np.unique(codes)
        index = simhash.GrayIndex(codes)
        for d in (0, 1, 2, 3):
            who, place = index.near(codes, d)
            want = {(i, int(c)) for i, q in enumerate(codes) for c in codes if (int(q) ^ int(c)).bit_count() <= d}
            assert {(int(i), int(index.codes[p])) for i, p in zip(who, place)} == want
            assert len(who) == len(want)


@pytest.mark.parametrize("group_rows", [3, 50_000])
def test_chains_and_split_groups(spark, group_rows):
    rng = random.Random(4)
    codes = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        codes.append(codes[rng.randrange(len(codes))] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    codes = sorted(set(codes))
    want = slow_groups([(c - (c >> 63 << 64), c) for c in codes])
    distinct = spark.createDataFrame([(c - (c >> 63 << 64),) for c in codes], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, group_rows=group_rows)).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_odd_rows(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts).withColumns({"fingerprint": F.lit("clash"), "component_id": F.lit(9)})
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(odd_texts)
    assert got[0]["fingerprint"] == "0" * 16 and {got[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert got[4]["component_id"] == got[5]["component_id"] == 4
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_of_each(spark, docs_of):
    docs = docs_of(["a b c d e f", "other words are here now", "a b c d e f", None, ""])
    kept = simhash.one_of_each(docs.unionAll(docs.where("doc_id = 1")))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3]
    assert simhash.one_of_each(docs.limit(0)).collect() == []
