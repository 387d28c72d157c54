import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from newsweave.llm import pieces, queries


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.default_model())


def test_random_texts_as_the_library(model, library):
    rng = random.Random(5)
    letters = "aehtnio srdlu\n\t ▁éß日😀%|.,'A"
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert model.encode(t) == ids
        assert model.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(6)
    some = [0, 1, 2, 3, 200, 258, 259, 260, 300, 13000, 31999, 229, 133, 175]
    for _ in range(1500):
        ids = [rng.choice(some) for _ in range(rng.randrange(9))]
        assert model.decode(ids) == library.decode(ids)


def test_pair_test_is_the_definition(model):
    rng = random.Random(7)
    names = sorted(model.right_edge)
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        assert model.stays_apart(a, b) == (model.merged(a + b)[0] == [a, b])


def test_query_as_the_library(spark, sf, read, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_pieces"](spark, sf).collect()}
    rows = read("documents").collect()
    assert len(got) == len(rows)
    for d in rows:
        ids = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, docs_of, odd_texts, library):
    docs = docs_of(odd_texts).withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(1)})
    out = pieces.decode(pieces.encode(docs, pieces.default_model()), pieces.default_model())
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    for r in out.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["decoded"] == library.decode(r["ids"])
    assert pieces.digests(docs, pieces.default_model()).count() == len(odd_texts)
    assert pieces.digests(docs.limit(0), pieces.default_model()).collect() == []


def test_digests_are_of_the_decoded_ids(library):
    """The digest of the decoded text comes from the ids: a model that shows an id otherwise gives another one."""
    own = pieces.PieceModel(pieces.default_model())
    text = "The quick brown fox\njumps, 日本 𒀀 é over\tit"
    ids = library.encode(text, add_bos=True, add_eos=True)
    n, of_ids, of_text = own.digest(text)
    assert n == len(ids) and of_ids == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert of_text == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for change in (lambda m: m.shown.__setitem__(own.word("▁quick")[0], "#"), lambda m: m.byte_of.__setitem__(own.byte_ids[0xF0], 0xF1)):
        other = pieces.PieceModel(pieces.default_model())
        change(other)
        assert other.digest(text)[1] == of_ids and other.digest(text)[2] != of_text
    other.alone[own.word("▁quick")[0]] = "#"
    assert other.digest("a quick text")[2] != own.digest("a quick text")[2] == hashlib.sha256(b"a quick text").hexdigest()
