import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import classifier as c
from newsweave.llm import queries


def slow_model(rows, labels):
    """The fit from (key, text) rows and labels, all rows in memory. Gives scores of all rows."""
    stats = {i: np.array(c.statistics(t)) for i, (_, t) in enumerate(rows)}
    train = [(stats[i], labels[k]) for i, (k, _) in enumerate(rows) if k in labels and zlib.crc32(str(k).encode()) % 3 != 1]
    x, y = np.array([s for s, _ in train]), np.array([v for _, v in train], float)
    deviation = x.std(axis=0)
    project = c.Projection(x.mean(axis=0), np.where(deviation > 1e-9, deviation, 1.0))
    z = project(x)
    total = z.T @ np.hstack([z, y[:, None]])
    penalty = np.full(len(total), c.PENALTY * len(y))
    penalty[-1] = 1e-9
    w = np.linalg.solve(total[:, :-1] + np.diag(penalty), total[:, -1])
    return {i: float((project(s[None]) @ w)[0]) for i, s in stats.items()}


def test_query(spark, sf, read):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_classifier"](spark, sf).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in read("documents").collect())
    labels = {r["doc_id"]: r["quality"] for r in read("labels").collect()}
    assert set(got) == {k for k, _ in docs}
    raw = slow_model(docs, labels)
    order = sorted(range(len(docs)), key=lambda i: raw[i])
    scores = [got[docs[i][0]]["score"] for i in order]
    # the calibration rises, so the scores rise with the ridge values of the slow fit
    assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:]))
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_accuracy(spark, read):
    """Rows of the other scale, by language: what is labelled junk goes, what is labelled good stays."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_classifier"](spark, sf).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    right: dict = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        g = got[r["doc_id"]]
        if g["held_out"]:
            right.setdefault((lang[r["doc_id"]], r["quality"]), []).append(g["predicted"] == r["quality"])
    for k, hits in right.items():
        assert sum(hits) >= 0.95 * len(hits), k


def test_partition_sums(spark):
    rng = np.random.default_rng(3)
    stats = rng.normal(size=(200, 4))
    rows = [([float(v) for v in s], float(s[0] > 0), i % 3) for i, s in enumerate(stats)]
    df = spark.createDataFrame(rows, "stats array<double>, y double, fold int").repartition(7)
    project = c.Projection(stats.mean(axis=0), stats.std(axis=0), features=12, kernel=2.0)
    got = c.normal_equations(df, project)
    for f in range(3):
        z, y = project(stats[f::3]), np.array([r[1] for r in rows[f::3]])
        assert np.allclose(got[f], z.T @ np.hstack([z, y[:, None]]))


def test_kernel_is_gaussian():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 5)) / 2
    z = c.Projection(np.zeros(5), np.ones(5), features=200_000, kernel=1.5)(x)[:, :-1]
    assert z[0] @ z[1] == pytest.approx(math.exp(-((x[0] - x[1]) ** 2).sum() / (2 * 1.5 ** 2)), abs=0.01)


def test_isotonic():
    place, n, ones = np.arange(6.0), np.array([1, 1, 2, 1, 1, 1.0]), np.array([0, 1, 0, 1, 0, 1.0])
    places, shares = c.isotonic(place, n, ones)
    assert shares.tolist() == [0, 1 / 3, 1 / 2, 1] and places.tolist() == [0, 5 / 3, 3.5, 5]


def test_odd_rows(spark, docs_of, odd_texts):
    good, bad = "The cat sat on the mat and looked at the moon.", "zz | zz | zz $$$ ***"
    docs = docs_of([*odd_texts, *[f"{good} {i}" for i in range(30)], *[f"{bad} {i}" for i in range(30)]])
    n = len(odd_texts)
    marks = spark.createDataFrame([(i, 1) for i in range(n, n + 30)] + [(i, 0) for i in range(n + 30, n + 60)] + [(n, 0), (None, 1), (7, 9)], "doc_id long, quality int")
    odd = docs.withColumns({"stats": F.lit("clash"), "score": F.lit("x"), "_key": F.lit(1)})
    got = {r["doc_id"]: r["score"] for r in c.scored(odd, marks).collect()}
    assert len(got) == n + 60 and all(0 <= s <= 1 for s in got.values())
    assert got[n] > 0.9 and got[n + 59] < 0.1
    assert c.scored(docs.limit(0), marks).collect() == []
    assert {r["score"] for r in c.scored(docs, marks.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in c.scored(docs, marks.where("quality = 0 and doc_id > 50")).collect()} == {0.0}
    twice = c.scored(docs.unionAll(docs).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))), marks)
    assert twice.count() == 2 * (n + 60)
    kept = c.score(c.described(docs, "doc_id", "text").withColumn("score", F.lit("x")), c.Classifier(None, np.zeros(0), np.zeros(1), np.array([0.25])))
    assert {r["score"] for r in kept.collect()} == {0.25}
