import re

import corpus_pipeline as cp
import pytest
from test_decontaminate import slow_best
from test_quality import slow_measures
from test_simhash import slow_fingerprint, slow_groups

from newsweave.llm import decontaminate, pieces, quality, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    """(docs before, docs after) of each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in cp.STAGES:
        after = stage(spark, docs, sf).cache()
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == cp.COLUMNS
        assert after.subtract(before).count() == 0


def test_quality(stages, read):
    before, after = stages[0]
    kept = ids(after)
    for r in before.collect():
        m = slow_measures(r["text"])
        if m[0] < 20 or 100 * m[4] > 30 * m[0]:
            assert r["doc_id"] not in kept
    assert kept == {r["doc_id"] for r in quality.judged(before, labels=read("labels")).collect() if r["kept"]}


def test_quality_learns_from_every_good_label(spark, docs_of, tmp_path, monkeypatch):
    """No id is kept out of the counts: the first model of the stage sees each text labelled good."""
    texts = [f"number {i} of the plain words " * 5 for i in range(40)]
    docs = docs_of([*texts, None])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(41)] + [(None, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    counted = []

    def seen(docs, text, first=None, count=quality.count_grams):
        if first is None:
            counted.append(sorted(r[text] for r in docs.collect()))
        return count(docs, text, first)
    monkeypatch.setattr(quality, "count_grams", seen)
    assert cp.quality_stage(spark, docs, str(tmp_path)).columns == cp.COLUMNS
    assert counted == [sorted(t for i, t in enumerate(texts) if i % 4)]


def test_toxicity(stages, read):
    before, after = stages[1]
    kept = ids(after)
    words = re.compile("idiot|moron|scum|trash|worthless|pathetic|loser|clown|disgusting|stupid", re.I)
    clean = [r["doc_id"] for r in before.collect() if not words.search(r["text"]) and r["lang"] == "en"]
    assert sum(k in kept for k in clean) >= 0.97 * len(clean)
    model = toxicity.train(before, read("labels"))
    assert kept == {r["doc_id"] for r in toxicity.score(before, model).collect() if r["score"] < 0.5}


def test_near_duplicates(stages):
    before, after = stages[2]
    groups = slow_groups([(r["doc_id"], slow_fingerprint(r["text"])) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(groups.values()))


def test_decontamination(stages, read):
    before, after = stages[3]
    kept = ids(after)
    items = [decontaminate.normal(r["text"]) for r in read("benchmark").collect()]
    for r in before.collect():
        text = decontaminate.normal(r["text"])
        if any(i in text for i in items):
            assert r["doc_id"] not in kept
        elif r["doc_id"] not in kept:
            assert any(slow_best(i, text)[0] <= len(i) // decontaminate.PER_ERROR for i in items)


def test_pieces(stages):
    before, after = stages[4]
    model = pieces.PieceModel(pieces.default_model())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    got = after.collect()
    assert {r["doc_id"] for r in got} == set(texts) and all(r["n_tokens"] == len(model.encode(texts[r["doc_id"]])) for r in got)


def test_run(spark, sf, stages):
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_rows(spark, sf, docs_of, odd_texts):
    for docs in (docs_of(odd_texts), docs_of(odd_texts).limit(0)):
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == cp.COLUMNS
            assert stage(spark, docs, sf).count() <= docs.count()
        assert cp.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_null_and_repeated_ids(spark, sf, read):
    """Rows are judged by their own text whatever their ids; of near duplicates the smallest id stays, and a group without an id keeps one row."""
    item = read("benchmark").first()["text"]
    sample = [r["text"] for r in read("documents").orderBy("doc_id").limit(60).collect()]
    texts = sample + [f"{sample[1]} {item}", None, "", "one two " * 60]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    unique = spark.createDataFrame([(10**9 + i, t, "en", "s", 0) for i, t in enumerate(texts)], schema)
    shared = spark.createDataFrame([((None, 10**9)[i % 2], t, "en", "s", 0) for i, t in enumerate(texts)], schema)
    for name, stage in cp.STAGES:
        if name in ("quality", "toxicity", "decontamination"):
            want, got = (sorted(r["text"] or "" for r in stage(spark, docs, sf).collect()) for docs in (unique, shared))
            assert want == got and (name == "toxicity" or 0 < len(got) < len(texts)), name
        elif name == "pieces":
            want, got = (sorted(tuple(r)[1:] for r in stage(spark, docs, sf).collect()) for docs in (unique, shared))
            assert want == got and len(got) == len(texts)
    dedup = dict(cp.STAGES)["near_duplicates"]
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "e f g h"), (5, "e f g h"), (4, "e f g h"), (7, "x y z"), (7, "q r s t"), (None, "e f g h")]
    got = dedup(spark, spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], schema), sf).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["doc_id"] != 7) == [("4", "e f g h"), ("None", "a b c d")]
    assert sum(r["doc_id"] == 7 for r in got) == 1
