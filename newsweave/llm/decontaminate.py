"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may appear in a document with up to ``k = n // per_error`` edits.
Cut into k + 1 pieces, at least one piece must then stand in the document unchanged. One
automaton finds all pieces of all items in one walk over the whole text; each hit says where
the item would start, give or take k. Hits of one item whose places overlap form one window,
and Myers' bit-parallel algorithm finds the least number of edits with which the item ends at
each place of that window. Every exact place is reported, and every other within the budget that
does not overlap a reported one; nothing beyond the budget is.

Texts are compared with A-Z and other letters lower-cased and each run of white space as one
space; reported spans are places in the original text. A null or empty text has no match, a null or empty
item none either. An item shorter than ``shortest`` characters has no budget and must stand between word
ends, as a part of a word says nothing. Items that are equal after this normalisation are all reported. Repeated rows give
repeated rows; very long texts are searched whole; empty tables give an empty result; further columns of either table are not looked at.

Items are written with a block number, for blocks of about ``block_chars`` characters (one item at least), and each block is read by its
number for one pass over the documents. More than one block gives results that are written block by block, so neither the
driver nor a task holds more than one.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.common import cells, map_batches, once, stored
from newsweave.session import scratch_path

#: One edit is allowed for so many characters of an item; characters from which on an item has a budget; characters of items in one pass.
PER_ERROR, SHORTEST, BLOCK_CHARS = 12, 24, 4_000_000

MATCH = "item_id long, span_start int, span_end int, edits int, item_chars int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


class Items:
    """Automaton over the pieces of a block of items: ``((item_id, text), ...)``."""

    def __init__(self, items: tuple[tuple[int, str], ...], per_error: int, shortest: int = 0):
        self.ids: dict[str, list[int]] = defaultdict(list)
        for key, text in items:
            if normal(text):
                self.ids[normal(text)].append(key)
        self.texts = list(self.ids)
        self.short = [len(t) < shortest for t in self.texts]
        self.budget = [0 if s else len(t) // per_error for t, s in zip(self.texts, self.short)]
        self.masks = [letter_masks(t) for t in self.texts]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (t, k) in enumerate(zip(self.texts, self.budget)):
            cuts = [j * len(t) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places[t[a:b]].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end): the parts of a normalised text where an item may be, overlapping ones joined."""
        starts: dict[int, list[int]] = defaultdict(list)
        if self.texts:
            for end, (length, where) in self.automaton.iter(text):
                for item, offset in where:
                    starts[item].append(end + 1 - length - offset)
        for item, found in starts.items():
            k, n = self.budget[item], len(self.texts[item])
            found.sort()
            first = last = found[0]
            for s in [*found[1:], None]:
                if s is not None and s - k <= last + n + k:
                    last = s
                    continue
                yield item, max(0, first - k), min(len(text), last + n + k)
                first = last = s

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits): the places of a normalised text where an item stands. All exact ones, and of the others the best of
        those that overlap, the first of equals; a place within the budget is left out only where it overlaps one that is given."""
        for item, a, b in self.windows(text):
            t, free = self.texts[item], a
            gaps, at = [], text.find(t, a, b)
            if self.short[item]:
                while at >= 0:
                    if not (inside_word(text, at) or inside_word(text, at + len(t))):
                        yield item, at, at + len(t), 0
                    at = text.find(t, at + 1, b)
                continue
            while at >= 0:
                yield item, at, at + len(t), 0
                gaps.append((free, at))
                free, at = at + len(t), text.find(t, at + 1, b)
            gaps.append((free, b))
            while gaps:
                a, b = gaps.pop()
                if b - a < len(t) - self.budget[item]:
                    continue
                found = self.edited(item, text, a, b)
                yield from ((item, *place) for place in found)
                if found:
                    gaps += zip([a, *(end for _, end, _ in found)], [*(start for start, _, _ in found), b])

    def edited(self, item: int, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of places in text[a:b] that do not overlap, in their order: fewest edits first, then the first end."""
        k, t = self.budget[item], self.texts[item]
        n, found = len(t), []
        back = letter_masks(t[::-1])
        for edits, end in sorted((d, e) for e, d in ends(self.masks[item], n, text, a, b) if d <= k):
            at = bisect.bisect_left(found, (end,))
            # a place has n - k characters at least
            if at < len(found) and found[at][0] < end or at and found[at - 1][1] > end - max(1, n - k):
                continue
            # the start is the nearest from which the item reversed, read back from the end, takes as many edits
            before = text[max(a, end - n - k):end][::-1]
            start = end - next(e for e, d in ends(back, n, before, 0, len(before), True) if d == edits)
            if not at or found[at - 1][1] <= start:
                found.insert(at, (start, end, edits))
        return found


def inside_word(text: str, at: int) -> bool:
    """Whether a place lies between two letters or digits."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def letter_masks(t: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(t):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], n: int, text: str, a: int, b: int) -> tuple[int, int]:
    """Myers: where in text[a:b] the pattern ends with the fewest edits, and how many these are; the first of equals."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, edits = full, 0, n
    best, place, get = n, a, masks.get
    for i in range(a, b):
        hit = get(text[i], 0)
        same = (((hit & up) + up) ^ up) | hit | down
        plus, minus = down | ~(same | up), up & same
        if plus & high:
            edits += 1
        elif minus & high:
            edits -= 1
            if edits < best:
                best, place = edits, i + 1
        plus, minus = plus << 1, minus << 1
        step = hit | down
        up, down = (minus | ~(step | plus)) & full, plus & step & full
    return place, best


def ends(masks: dict[str, int], n: int, text: str, a: int, b: int, anchored: bool = False) -> Iterator[tuple[int, int]]:
    """Myers: each end in text[a:b] and the fewest edits with which the pattern ends there, from any start, or from ``a``."""
    full, high, first = (1 << n) - 1, 1 << (n - 1), int(anchored)
    up, down, edits, get = full, 0, n, masks.get
    for i in range(a, b):
        hit = get(text[i], 0)
        same = (((hit & up) + up) ^ up) | hit | down
        plus, minus = down | ~(same | up), up & same
        if plus & high:
            edits += 1
        elif minus & high:
            edits -= 1
        yield i + 1, edits
        plus, minus = plus << 1 | first, minus << 1
        step = hit | down
        up, down = (minus | ~(step | plus)) & full, plus & step & full


def original_places(text: str) -> list[int]:
    """For each character of ``normal(text)`` its place in ``text``, and at the end the place after the last word."""
    places, end = [], 0
    for i, c in enumerate(text):
        if c.isspace():
            continue
        if places and i > end:
            places.append(end)
        places += [i] * len(c.lower())
        end = i + 1
    return [*places, end]


def find_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", per_error: int = PER_ERROR, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and place of an item: key, item_id, span_start, span_end (code points of the original text,
    end not included), edits, item_chars."""
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where("_text is not null")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {MATCH}"
    table, parts = blocks(items, item_key, item_text, block_chars)
    out = None
    for part in range(parts):
        found = map_batches(source, search(block_of(table, part), key, per_error, shortest), schema)
        if parts == 1:
            return found
        out = out or scratch_path(docs.sparkSession, "found")
        found.write.mode("append").parquet(out)
    return map_batches(source.limit(0), search((), key, per_error, shortest), schema) if out is None else docs.sparkSession.read.schema(schema).parquet(out)


def blocks(items: DataFrame, item_key: str, item_text: str, block_chars: int) -> tuple[DataFrame, int]:
    """The items that are not null as a written table (_item, _words, _block), and the number of blocks."""
    rows = items.select(F.col(item_key).cast("long").alias("_item"), F.col(item_text).cast("string").alias("_words")).where("_words is not null")
    chars = rows.agg(F.sum(F.length("_words"))).first()[0]
    if chars is None:
        return rows, 0
    parts = max(1, -(-chars // block_chars))
    return stored(rows.withColumn("_block", F.pmod(F.xxhash64("_item", "_words"), F.lit(parts)).cast("int")), "items"), parts


def block_of(table: DataFrame, part: int) -> tuple[tuple[int, str], ...]:
    """One block, read by its number."""
    return tuple((r["_item"], r["_words"]) for r in table.where(F.col("_block") == part).orderBy("_item", "_words").collect())


def search(block: tuple, key: str, per_error: int, shortest: int):
    def run(batches):
        index = once(Items, block, per_error, shortest)
        for b in batches:
            rows = []
            for k, t in zip(cells(b, "_key"), cells(b, "_text")):
                hits = list(index.matches(normal(t)))
                if not hits:
                    continue
                places = original_places(t)
                for item, start, end, edits in hits:
                    for i in index.ids[index.texts[item]]:
                        rows.append((k, i, places[start], places[end - 1] + 1 if end > start else places[start], edits, len(index.texts[item])))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [b.schema.field("_key").type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             [key, "item_id", "span_start", "span_end", "edits", "item_chars"])
    return run


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  per_error: int = PER_ERROR, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows in whose text no item is found, with all their columns, by one pass per block and without a shuffle."""
    schema = docs.schema
    table, parts = blocks(items, item_key, item_text, block_chars)
    for part in range(parts):
        docs = map_batches(docs, clean_rows(block_of(table, part), text, per_error, shortest), schema)
        docs = docs if part == parts - 1 else stored(docs, "clean")
    return docs


def clean_rows(block: tuple, text: str, per_error: int, shortest: int):
    def run(batches):
        index = once(Items, block, per_error, shortest)
        for b in batches:
            clean = [t is None or next(index.matches(normal(t)), None) is None for t in cells(b, text)]
            yield b.filter(pa.array(clean, pa.bool_()))
    return run
