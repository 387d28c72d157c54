import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import queries, toxicity


def written(rng, n):
    syllables = "th er on an re he in ed nd ha at en es of or".split()
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """(text, toxic): ordinary made-up prose; the toxic have one of three insults in it, twice or more."""
    rng, rows = random.Random(9), []
    for i in range(700):
        words, y = written(rng, rng.randrange(40, 300)), int(i % 5 == 0)
        if y:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["grubblex", "vilmopod", "snarkwit"]))
        rows.append((" ".join(words), y))
    return rows


def test_held_out_accuracy(corpus):
    train, rest = corpus[:500], corpus[500:]
    ordinary, toxic, weights, by_level = toxicity.fit([t for t, y in train if y], [t for t, y in train if not y])
    meter = toxicity.Meter(ordinary, toxic)

    def scored(text):
        return by_level[toxicity.level(float(toxicity.looks(meter.gains(text)[None])[0] @ np.array(weights)))]
    said = [(scored(t) >= 0.5, y) for t, y in rest]
    assert sum(p for p, y in said if y) >= 0.95 * sum(y for _, y in said)
    assert sum(p for p, y in said if not y) <= 0.03 * sum(1 - y for _, y in said)
    assert list(by_level) == sorted(by_level) and 0 <= by_level[0] and by_level[-1] <= 1
    assert meter.gains(("then and other " * 5000) + " GRUBBLEX " + "of the and " * 5000)[5:].sum() == 1


def test_gains_from_compressed_lengths(corpus):
    """Each word's gain by compressing it anew with both dictionaries; words of wide windows that gain nothing count as 0."""
    ordinary, toxic = toxicity.trained([t for t, y in corpus[:200] if y], [t for t, y in corpus[:200] if not y])
    meter, rng = toxicity.Meter(ordinary, toxic), random.Random(0)
    filled = bytes(rng.randrange(240, 256) for _ in range(len(toxic)))

    def length(content, strategy, text):
        return len(toxicity.compressor(content, strategy)(text))
    for text, _ in corpus[200:212]:
        want = [0] * (toxicity.MOST + 1)
        raw, gaining = text.lower().encode(), set()
        for window in toxicity.WINDOWS.findall(raw):
            if length(filled + ordinary, toxicity.FAST, b" " + window + b" ") > length(toxic + ordinary, toxicity.FAST, b" " + window + b" "):
                gaining |= set(window.split())
        for w in set(raw.split()):
            anchored = b" " + w + b" " + toxicity.ANCHOR
            gain = sum(max(0, length(filled + ordinary, s, anchored) - length(toxic + ordinary, s, anchored)) for s in (toxicity.FAST, toxicity.THOROUGH))
            want[min(gain, toxicity.MOST) if w in gaining else 0] += 1
        assert meter.gains(text).tolist() == want
    assert meter.gains(None).tolist() == meter.gains("").tolist() == [0] * (toxicity.MOST + 1)


def test_score_from_its_parts(spark, docs_of, corpus):
    """The score of every row from gains, weights and levels, one row at a time; folds in tasks give what folds in turn give."""
    texts = [t for t, _ in corpus]
    toxic, ordinary = ([t for t, y in corpus[:300] if y == label] for label in (1, 0))
    model = toxicity.fit(toxic, ordinary)
    assert toxicity.fit(toxic, ordinary, spark) == model
    meter = toxicity.Meter(*model[:2])
    for r in toxicity.score(docs_of(texts[300:420]), model).collect():
        counts = meter.gains(texts[300 + r["doc_id"]])
        reached = [int(counts[g:].sum()) for g in toxicity.GAINS]
        n = int(counts.sum())
        look = [math.log1p(x) for x in reached] + [math.sqrt(1000 * x / (n + 50)) for x in reached] + [math.log1p(n), 1.0]
        evidence = sum(a * b for a, b in zip(look, model[2]))
        assert r["evidence"] == pytest.approx(evidence, abs=1e-9)
        assert r["score"] == model[3][int(min(toxicity.LEVELS, max(0.0, 2 * (evidence + 10))))]


def test_pooled_is_the_nearest_rising_curve():
    assert toxicity.pooled(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    assert toxicity.pooled(np.array([3.0, 0.0]), np.array([1.0, 2.0])).tolist() == [1, 1]


def test_training_rows(spark, corpus, docs_of):
    docs = docs_of([t for t, _ in corpus])
    labels = spark.createDataFrame([(i, y, None) for i, (_, y) in enumerate(corpus)] + [(0, 1, None), (5000, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels, learn=F.col("doc_id") < 500)
    # nothing of the rows that are not learnt from, and each label's own rows
    again = toxicity.train(docs.where("doc_id < 500"), labels)
    assert model == again
    scored = toxicity.score(docs.withColumns({"score": F.lit("clash")}), model).collect()
    assert sum(abs((r["score"] >= 0.5) - corpus[r["doc_id"]][1]) for r in scored) <= 15


def test_query(spark, sf, read):
    got = queries.QUERIES["op4_toxicity"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in read("documents").select("doc_id").collect())
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_odd_rows(spark, docs_of, odd_texts, corpus):
    docs = docs_of(odd_texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(odd_texts))], "doc_id long, toxic int")
    for model in (toxicity.train(docs, labels), toxicity.train(docs, labels.limit(0)), toxicity.train(docs.limit(0), labels)):
        assert toxicity.score(docs, model).count() == len(odd_texts)
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []
