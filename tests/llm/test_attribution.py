import random

import numpy as np
import pytest

from newsweave.llm import attribution as at
from newsweave.llm import queries


def slow(start, end, sections, rule):
    counts, rest = [0.0] * len(sections), 0.0
    for a, b in zip(start, end):
        inside = [max(0, min(b, h) - max(a, low)) for low, h in sections]
        outside = (b - a) - sum(inside)
        if rule == "shares":
            counts = [c + i / (b - a) for c, i in zip(counts, inside)]
            rest += outside / (b - a)
            continue
        if rule == "most":
            at_ = inside.index(max(inside)) if max(inside) > 0 and max(inside) >= outside else None
        else:
            place = a if rule == "start" else b - 1
            at_ = next((i for i, (low, h) in enumerate(sections) if low <= place < h), None)
        if at_ is None:
            rest += 1
        else:
            counts[at_] += 1
    return counts, rest


@pytest.mark.parametrize("rule", at.RULES)
def test_intervals(rule):
    rng = random.Random(8)
    for _ in range(400):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(rng.randrange(1, 20))])
        start, size = np.r_[0, ends[:-1]], int(ends[-1])
        edges = sorted(rng.sample(range(size + 3), min(size + 3, 2 * rng.randrange(1, 4))))
        sections = list(zip(edges[::2], edges[1::2])) if rng.random() < 0.5 else list(zip([0, *edges], [*edges, size]))
        counts, rest = at.allotted(start, ends, sections, rule)
        want, left = slow(start.tolist(), ends.tolist(), sections, rule)
        assert np.allclose(counts, want) and abs(rest - left) < 1e-9
        assert abs(counts.sum() + rest - len(ends)) < 1e-9


def test_query_adds_up(spark, sf, read):
    encoder = at.Encoder(*at.default_encoder())
    got = {}
    for r in queries.QUERIES["op6_tokens"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d in read("documents").collect():
        rows = sorted(got[d["doc_id"]], key=lambda r: r["section"])
        ids = encoder.encoding.encode_ordinary(d["text"] or "")
        raw = (d["text"] or "").encode()
        assert sum(r["n_tokens"] for r in rows) == len(ids) == rows[0]["doc_tokens"]
        assert b"".join(raw[r["span_start"]:r["span_end"]] for r in rows) == raw
        ends = np.cumsum([len(encoder.encoding.decode_single_token_bytes(i)) for i in ids])
        want, rest = slow([0, *ends[:-1].tolist()] if len(ends) else [], ends.tolist(), [(r["span_start"], r["span_end"]) for r in rows], "most")
        assert rest == 0 and [r["n_tokens"] for r in rows] == want


def test_odd_rows(spark, docs_of, odd_texts):
    for rule in at.RULES:
        got = at.section_tokens(docs_of(odd_texts), at.default_encoder(), rule=rule)
        assert {r["doc_id"] for r in got.collect()} == set(range(len(odd_texts)))
    assert at.section_tokens(docs_of(odd_texts).limit(0), at.default_encoder()).collect() == []
    with pytest.raises(ValueError):
        at.section_tokens(docs_of(["x"]), at.default_encoder(), rule="other")
    gaps = at.section_tokens(docs_of(["one two three four"]), at.default_encoder(), sections=lambda raw: [(0, 3), (8, 13)]).collect()
    assert {(r["section"], r["n_tokens"]) for r in gaps} == {(0, 1.0), (1, 1.0), (-1, 2.0)}
