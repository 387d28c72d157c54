import random

from pyspark.sql import functions as F

from newsweave.llm import decontaminate as dc
from newsweave.llm import queries


def slow_best(pattern, text):
    """(edits, end) of the best place of a pattern in a text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(800):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        end, edits = dc.best_end(dc.letter_masks(p), len(p), t, 0, len(t))
        want, place = slow_best(p, t)
        assert edits == want and (edits == len(p) or end == place)


def test_all_matches_within_the_budget():
    rng = random.Random(2)
    for _ in range(200):
        items = tuple((i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(24, 60)))) for i in range(3))
        index = dc.Items(items, 8)
        edited = list(dc.normal(rng.choice(items)[1]))
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(edited))
            edited[at:at + 1] = rng.choice([[], ["a"], [edited[at], "b"]]) if len(edited) > 1 else ["a"]
        text = dc.normal("".join(rng.choice("abcd ") for _ in range(50)) + "".join(edited) + "".join(rng.choice("abcd ") for _ in range(50)))
        got = {}
        for item, start, end, edits in index.matches(text):
            assert slow_best(index.texts[item], text[start:end])[0] <= edits
            got[item] = min(edits, got.get(item, 99))
        for i, t in enumerate(index.texts):
            edits = slow_best(t, text)[0]
            assert got.get(i) == (edits if edits <= index.budget[i] else None)


def test_query_finds_every_exact_passage(spark, sf, read):
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op8_decontaminate"](spark, sf).collect()}
    docs, items = read("documents").collect(), read("benchmark").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if dc.normal(i["text"]) in dc.normal(d["text"] or "")}
    assert want and want <= got
    texts, wanted = {d["doc_id"]: d["text"] for d in docs}, {i["item_id"]: dc.normal(i["text"]) for i in items}
    for k, i in got - want:
        assert slow_best(wanted[i], dc.normal(texts[k]))[0] <= len(wanted[i]) // dc.PER_ERROR


def test_spans_blocks_and_odd_rows(spark, docs_of, odd_texts):
    item = "Which of the rivers in the north flows into the sea first"
    texts = [*odd_texts, f"Before.\n  {item.upper().replace(' ', '   ')} and after", f"x {item[:20]}Q{item[21:]} y", item[:40]]
    docs = docs_of(texts).withColumn("edits", F.lit("clash"))
    items = spark.createDataFrame([(1, item), (2, None), (3, "unheard of"), (4, "Another test question that nobody asks at all"), (5, item)], "item_id long, text string")
    for chars in (10, 10_000):
        found = dc.find_matches(docs, items, block_chars=chars).collect()
        n = len(odd_texts)
        assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found) == [(n, 1, 0), (n, 5, 0), (n + 1, 1, 1), (n + 1, 5, 1)]
        for r in found:
            if r["doc_id"] == n:
                assert dc.normal(texts[n][r["span_start"]:r["span_end"]]) == dc.normal(item)
        clean = dc.without_leaks(docs, items, block_chars=chars)
        assert clean.columns == docs.columns
        assert sorted(r["doc_id"] for r in clean.collect()) == [*range(n), n + 2]
    assert dc.find_matches(docs.limit(0), items).collect() == []
    assert dc.find_matches(docs, items.limit(0)).collect() == []
    assert dc.without_leaks(docs, items.limit(0)).count() == len(texts)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_every_place_against_all_spans():
    rng = random.Random(4)
    for _ in range(60):
        item = "".join(rng.choice("abcd") for _ in range(rng.randrange(24, 32)))
        index = dc.Items(((1, item),), 8)
        n, k, text = len(item), len(item) // 8, ""
        for _ in range(rng.randrange(1, 6)):
            copy = list(item)
            for _ in range(rng.randrange(k + 2)):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[], ["e"], [copy[at], "b"]])
            text += "".join(copy) + rng.choice(["", "", " ", "dddd", item[:9], item[-9:]])
        text = dc.normal(text)
        got = [m[1:] for m in index.matches(text)]
        assert len(set(got)) == len(got)
        exact = {i for i in range(len(text)) if text.startswith(item, i)}
        assert {a for a, _, d in got if d == 0} == exact
        for a, b, d in got:
            assert distance(item, text[a:b])[-1] == d <= k
            assert d == 0 or not any(x < b and a < y for x, y, _ in got if (x, y) != (a, b))
        for a in range(len(text)):
            for size, d in enumerate(distance(item, text[a:a + n + k])):
                if d <= k:
                    assert any(x < a + size and a < y for x, y, _ in got), (item, text, a, size, got)


def test_repeated_and_adjacent_places(docs_of, spark):
    item = "Which of the rivers in the north flows into the sea first"
    near = item.replace("rivers", "rivars")
    texts = [" ".join([item] * 7), item + " " + near, near + near + " " + item, near + " x " + near]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = dc.find_matches(docs_of(texts), items).collect()
    edits = {i: [r["edits"] for r in sorted(got, key=lambda r: r["span_start"]) if r["doc_id"] == i] for i in range(4)}
    assert edits == {0: [0] * 7, 1: [0, 1], 2: [1, 1, 0], 3: [1, 1]}


def test_short_items_exactly_and_between_word_ends(docs_of, spark):
    items = spark.createDataFrame([(1, "Who sank?"), (2, "cat"), (3, ""), (4, " \n"), (5, "a"), (6, None)], "item_id long, text string")
    texts = ["He asked: WHO  sank? Nobody.", "concatenate", "the cat, a cat", "who sink?", "", None, "x" * 50 + " cat"]
    got = dc.find_matches(docs_of(texts), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(0, 1, 0), (2, 2, 0), (2, 2, 0), (2, 5, 0), (6, 2, 0)]
    assert sorted(texts[2][r["span_start"]:r["span_end"]] for r in got if r["doc_id"] == 2) == ["a", "cat", "cat"]
    assert sorted(r["doc_id"] for r in dc.without_leaks(docs_of(texts), items).collect()) == [1, 3, 4, 5]


def test_blocks_hold_all_items(spark):
    items = spark.createDataFrame([(i, f"item number {i} of the test") for i in range(200)] + [(None, "x"), (5, None)], "item_id long, text string")
    table, parts = dc.blocks(items, "item_id", "text", 500)
    found = [dc.block_of(table, p) for p in range(parts)]
    assert parts > 5 and sorted(x[0] for b in found for x in b if x[0] is not None) == list(range(200)) and sum(map(len, found)) == 201
    assert dc.blocks(items.limit(0), "item_id", "text", 500)[1] == 0
