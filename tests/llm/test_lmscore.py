import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import lmscore, queries


def folds(rows, m=10):
    texts = {k: [*(t or "").encode().lower().split(), b""] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % m == 0 for k in texts}
    counts = Counter(w for k, ws in texts.items() if not held[k] for w in ws)
    return texts, held, counts


def checked(got, rows):
    texts, held, c = folds(rows)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        ws = texts[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_query(spark, sf, read):
    got = queries.QUERIES["op9_lmscore"](spark, sf).collect()
    checked(got, [(r["doc_id"], r["text"]) for r in read("documents").collect()])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def slow_scores(rows):
    """The model of the docstring, state by state and word by word."""
    texts, held, c = folds(rows)
    train = [ws for k, ws in texts.items() if not held[k]]
    pairs = Counter((h, w) for ws in train for h, w in zip([b"", *ws], ws))
    triples = Counter((g, h, w) for ws in train for g, h, w in zip([b"", *ws], ws, ws[1:]))
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == i for x in c.values()) for i in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    def solved(histories, singletons):
        mass = [sum(x * k / (x - 1 + k) for x in histories) for k in lmscore.PRIORS]
        return math.exp(np.interp(singletons, mass, np.log(lmscore.PRIORS))) if mass[-1] else 1.0
    k1 = solved(list(c.values()), sum(x == 1 for x in pairs.values()))
    k2 = solved([x for (_, w), x in pairs.items() if w], sum(x == 1 for x in triples.values()))

    def word(w):
        return max(c[w] - d, 0) / n + d * v / n / (v + 1)

    def arc(state, w):
        """(weight, next state) of the state's arc for a word, or None."""
        longest = (state[-1], w) if state and pairs[state[-1], w] else (w,) if c[w] else ()
        if len(state) == 2 and triples[*state, w]:
            return (triples[*state, w] + k2 * value(state[1:], w)) / (pairs[state] + k2), longest
        if len(state) == 1 and pairs[*state, w]:
            return (pairs[*state, w] + k1 * word(w)) / (c[state[0]] + k1), longest
        return (word(w), (w,) if c[w] else ()) if not state else None

    def value(state, w):
        found = arc(state, w)
        return found[0] if found else k1 / (c[state[0]] + k1) * word(w)

    def walked(ws):
        state, total = ((b"",) if c[b""] else ()), 0.0
        for w in ws:
            while not (found := arc(state, w)):
                total += math.log10(k2 / (pairs[state] + k2) if len(state) == 2 else k1 / (c[state[0]] + k1))
                state = state[1:] if len(state) == 2 else ()
            total, state = total + math.log10(found[0]), found[1]
        return total
    # every state's arcs and the failure arc add up to one, an unknown word being one word
    for state in [(), (b"the",), (b"the", b"cat")]:
        if not state or (len(state) == 1 and c[state[0]]) or (len(state) == 2 and pairs[state]):
            def p(s, w):
                f = arc(s, w)
                if f:
                    return f[0]
                return (k2 / (pairs[s] + k2) if len(s) == 2 else k1 / (c[s[0]] + k1)) * p(s[1:], w)
            if (sum(c.values()) and state != ()) or state == ():
                assert sum(p(state, w) for w in [*c, b"\xff unheard"]) == pytest.approx(1.0)
    return {k: walked(ws) for k, ws in texts.items()}


TEXTS = ["the cat sat on the mat", "The dog sat on the mat", "a cat and a dog", None, "", "the the the", "new words here xyz", "on the mat the cat sat",
         "the cat sat on the mat and the cat sat on the dog"] * 4


@pytest.mark.parametrize("block_chars, buckets, stride", [(10**6, 3, 512), (200, 7, 2), (1, 1, 1), (90, None, 3)])
def test_against_walk_word_by_word(spark, docs_of, monkeypatch, block_chars, buckets, stride):
    monkeypatch.setattr(lmscore.Automaton.walk, "__defaults__", (stride,))
    docs = docs_of(TEXTS).repartition(3).withColumns({"score": F.lit("clash"), "held_out": F.lit(1), "block": F.lit(3)})
    got = lmscore.score(docs, block_chars=block_chars, buckets=buckets).collect()
    rows = list(enumerate(TEXTS))
    checked(got, rows)
    want = slow_scores(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_walk_in_parts_is_the_walk(spark, read):
    """Parts start in the state that the words before them lead to."""
    texts = [r["text"] for r in read("documents").orderBy("doc_id").limit(40).collect()]
    block = lmscore.numbered(texts)
    keep = np.arange(len(texts)) % 3 > 0
    counts = block.counts(block.asked(keep))
    sums = lmscore.totals(block.keys, block.asked(keep).astype(np.int64))
    automaton = lmscore.Automaton(block, counts, lmscore.Smoothing(sums))
    whole = automaton.walk(block, 10**9)
    for stride in (1, 7, 100):
        assert np.allclose(automaton.walk(block, stride), whole, rtol=1e-12)


def test_scores_do_not_depend_on_files(spark, read, tmp_path):
    docs = read("documents")
    scores = []
    for n in (1, 32):
        docs.repartition(n).write.parquet(str(tmp_path / str(n)))
        scores.append({r["doc_id"]: r["score"] for r in lmscore.score(spark.read.parquet(str(tmp_path / str(n))), block_chars=40_000 * n).collect()})
    # and of a table that comes out of a shuffle
    scores.append({r["doc_id"]: r["score"] for r in lmscore.score(docs.repartition(5, "text"), buckets=4).collect()})
    for other in scores[1:]:
        assert scores[0].keys() == other.keys()
        assert all(abs(scores[0][k] - other[k]) < 1e-6 for k in other)


def test_odd_rows(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts)
    checked(lmscore.score(docs).collect(), list(enumerate(odd_texts)))
    assert lmscore.score(docs.limit(0)).collect() == []
    only_held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    assert lmscore.score(only_held).count() == only_held.count()
    strings = docs.select(F.when(F.col("doc_id") > 2, F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert lmscore.score(strings).count() == len(odd_texts)
