"""Ranked lexical search over K2-treaps of a term-document grid.

Documents are indexed in blocks, each a range of columns; the rows of a block's grid are its terms, the cell of a term and a
document holds the term's impact there. The grid is a compressed quadtree in which every node keeps one cell: the one with the
largest impact below it, which is taken out of what its children hold (a treap). Stored are, level by level, four bits a node
(which quadrants go on), the impact as the difference from the parent's, and the place of the cell within the node. Empty
quadrants take no room; every cell of the grid is in exactly one node.

A search follows the row paths of all terms of an item together. Its state is a set of document ranges, each with one node for
each term; a range's bound is the sum over the terms of weight times the larger of the node's impact and of the impacts of
cells already met that lie in the range. The ranges with the best bounds are opened first, some at a time; a range of one
document has its exact score as bound. Ranges are left when their bound is below the last of the ``limit`` best, or equals
it and all their documents come later. So no document is scored that cannot be among the best, and the result is exact.

Scores, in 64-bit integers: weight ``floor(1000 ln((2N+2)/(2df+1)))`` times impact ``1000000000 tf div (1000 tf + 20 m)``, with
``m = 50 + 50 n N div L``. A first pass counts N and L, a second builds the blocks; both cover all documents. The
number of documents of a term is summed from the blocks' own. Each task keeps its own best ``limit`` rows of an item, a last step the best
of all, cut below the shuffle. Items are taken in blocks of about ``ITEM_CHARS`` characters (one item at least).

Terms are runs of ASCII digits, letters and characters beyond ASCII; A-Z are lower-cased. Null and empty texts have no term: they
are indexed and found by nothing, and an item without a term, or with none that a document holds, has no row. Very long texts
are whole columns; a block closes behind the document that fills it. Rows with the same id are
documents of their own; of equal scores the smaller id comes first, null ids last. Empty tables give empty results. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from newsweave.llm.common import cells, map_batches, stored

#: Cells from which on a block is closed; characters of the items searched for at once; ranges opened at once.
BLOCK_CELLS, ITEM_CHARS, AT_ONCE = 500_000, 2_000_000, 320
#: Of four quadrant bits: whether a quadrant goes on, and how many before it do.
GOES_ON = np.array([[bits >> q & 1 for q in range(4)] for bits in range(16)], bool)
GO_BEFORE = np.array([[bin(bits & ((1 << q) - 1)).count("1") for q in range(4)] for bits in range(16)], np.int32)
#: Everything below 0x80 but digits and letters parts terms.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, with repeats."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def length_factor(n: int, documents: int, total: int) -> int:
    """m of a document with n terms."""
    return 50 + 50 * n * documents // total


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def packed(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# ---------------------------------------------------------------- the treap of one grid

def spread(x: np.ndarray) -> np.ndarray:
    """The bits of a 32-bit number at every other place of 64."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def gathered(x: np.ndarray) -> np.ndarray:
    """Every other bit of a 64-bit number, as a 32-bit one."""
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def height_of(rows: int, columns: int) -> int:
    """Levels below the root of the least square that holds the grid."""
    return max(1, (max(rows, columns, 1) - 1).bit_length())


@dataclass
class Levels:
    """A treap as it is stored: by level from the root, nodes in the order of the quadrants."""

    height: int
    sizes: np.ndarray
    bits: np.ndarray
    drops: np.ndarray
    places: np.ndarray

    def stored(self) -> list[bytes]:
        return [packed(self.sizes), packed(self.bits), packed(self.drops), packed(self.places)]


def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> Levels:
    """Treap of the cells (row, column, value); no cell may stand twice."""
    code = (spread(rows) << np.uint64(1)) | spread(columns)
    order = np.argsort(code)
    code, values = code[order], values[order].astype(np.int32)
    sizes, bits, drops, places = [], [], [], []
    above = None
    for level in range(height + 1):
        if not len(code):
            break
        shift = np.uint64(2 * (height - level))
        node = code >> shift
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        best = np.maximum.reduceat(values, first)
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))
        tops = np.flatnonzero(values == best[of])
        tops = tops[np.r_[True, of[tops][1:] != of[tops][:-1]]]
        if above is not None:
            parents, parent_best = above
            at = np.searchsorted(parents, node[first] >> np.uint64(2))
            own = np.zeros(len(parents), np.uint8)
            np.bitwise_or.at(own, at, (1 << (node[first] & np.uint64(3)).astype(np.uint8)).astype(np.uint8))
            bits.append(own)
            drops.append(parent_best[at] - best)
        else:
            drops.append(-best)
        sizes.append(len(first))
        places.append(code[tops] & ((np.uint64(1) << shift) - np.uint64(1)))
        above = node[first], best
        stays = np.ones(len(code), bool)
        stays[tops] = False
        code, values = code[stays], values[stays]
    if sizes:
        bits.append(np.zeros(sizes[-1], np.uint8))

    def joined(parts, kind):
        return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return Levels(height, np.array(sizes, np.int64), joined(bits, np.uint8), joined(drops, np.int32), joined(places, np.uint64))


class Treap:
    """A treap to search in: of each node its impact, its cell, its quadrants and where its children start. Behind the nodes
    stands one that is empty, for rows without a node."""

    def __init__(self, levels: Levels):
        self.height, sizes = levels.height, levels.sizes.tolist()
        n = self.none = len(levels.bits)
        self.bits = np.append(levels.bits, np.uint8(0))
        count = np.bitwise_count(self.bits).astype(np.int32)
        self.first = (sizes[0] if sizes else 0) + np.cumsum(count, dtype=np.int32) - count
        self.value, prefix = np.zeros(n + 1, np.int32), np.zeros(n, np.uint64)
        start = 0
        for level, size in enumerate(sizes):
            here = slice(start, start + size)
            if level == 0:
                self.value[here] = -levels.drops[here]
            else:
                up = slice(start - sizes[level - 1], start)
                parent, quadrant = np.nonzero(GOES_ON[levels.bits[up]])
                self.value[here] = self.value[up][parent] - levels.drops[here]
                prefix[here] = (prefix[up][parent] << np.uint64(2)) | quadrant.astype(np.uint64)
            start += size
        place = (2 * (self.height - np.repeat(np.arange(len(sizes)), sizes))).astype(np.uint64)
        code = (prefix << place) | levels.places
        self.row = np.append(gathered(code >> np.uint64(1)).astype(np.int32), np.int32(-1))
        self.column = np.append(gathered(code).astype(np.int32), np.int32(0))

    def best(self, rows: np.ndarray, weights: np.ndarray, limit: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the ``limit`` best columns for weighted rows with a score above 0 and of at least ``floor``, best first, of
        equals the smaller column first."""
        columns, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not self.none or not len(rows):
            return columns, scores
        k, height, rows = len(rows), self.height, rows.astype(np.int32)
        # open ranges: level, first column, bound, number; their nodes; cells met in them: number of the range, term, column, impact
        level, start, number = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound, nodes = np.array([weights.sum() * int(self.value[0])], np.int64), np.zeros((1, k), np.int32)
        met = [np.empty(0, np.int64) for _ in range(4)]
        numbers = 1
        last, last_column = max(floor, 1), np.iinfo(np.int64).max
        while len(bound):
            if len(bound) > AT_ONCE:
                order = np.lexsort((start, -bound))
                now, later = order[:AT_ONCE], order[AT_ONCE:]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            nd = nodes[now]
            shift = height - 1 - level[now]
            chosen = np.full(numbers, -1, np.int64)
            chosen[number[now]] = np.arange(len(now))
            mine = chosen[met[0]]
            own = mine >= 0
            # the cells of the nodes themselves, where they lie in the row of their term
            i, j = np.nonzero(self.row[nd] == rows)
            cell = nd[i, j]
            of = np.concatenate([mine[own], i])
            term, column, value = (np.concatenate([m[own], x]) for m, x in zip(met[1:], (j, self.column[cell], self.value[cell])))
            met = [x[~own] for x in met]
            # both halves of the columns, the half of the rows in which the term lies
            quadrant = 2 * ((rows >> np.maximum(shift, 0)[:, None]) & 1)
            flags, first = self.bits[nd], self.first[nd]
            children = np.empty((len(now), 2, k), np.int32)
            for side in (0, 1):
                children[:, side] = np.where(GOES_ON[flags, quadrant + side], first + GO_BEFORE[flags, quadrant + side], self.none)
            children = children.reshape(-1, k)
            child = 2 * of + ((column >> np.maximum(shift[of], 0)) & 1)
            impact = self.value[children].astype(np.int64)
            np.maximum.at(impact, (child, term), value)
            child_bound = impact @ weights
            child_start = np.repeat(start[now], 2)
            child_start[1::2] += 1 << np.maximum(shift, 0)
            done = np.repeat(shift == 0, 2)
            if done.any():
                single = np.flatnonzero(done & (child_bound >= last))
                columns, scores = np.concatenate([columns, child_start[single]]), np.concatenate([scores, child_bound[single]])
                if len(scores) >= limit:
                    order = np.lexsort((columns, -scores))[:limit]
                    columns, scores = columns[order], scores[order]
                    last, last_column = int(scores[-1]), int(columns[-1])
            go = np.flatnonzero(~done & ((child_bound > last) | ((child_bound == last) & (child_start < last_column))))
            follows = np.full(len(child_bound), -1, np.int64)
            follows[go] = numbers + np.arange(len(go))
            stays = later[(bound[later] > last) | ((bound[later] == last) & (start[later] < last_column))]
            number = np.concatenate([number[stays], follows[go]])
            numbers += len(go)
            alive = np.zeros(numbers, bool)
            alive[number] = True
            keep, on = alive[met[0]], follows[child] >= 0
            met = [np.concatenate([m[keep], x[on]]) for m, x in zip(met, (follows[child], term, column, value))]
            level = np.concatenate([level[stays], np.repeat(level[now] + 1, 2)[go]])
            start, bound = np.concatenate([start[stays], child_start[go]]), np.concatenate([bound[stays], child_bound[go]])
            nodes = np.concatenate([nodes[stays], children[go]])
        order = np.lexsort((columns, -scores))[:limit]
        return columns[order], scores[order]


# ---------------------------------------------------------------- blocks of documents

class Collector:
    """Documents of a block while it fills: terms by number and the cells of the grid."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.keys, self.lengths, self.term, self.tf, self.sizes = [], [], [], [], []
        self.cells = 0

    def add(self, key, text: str | None) -> None:
        numbers, terms = self.numbers, terms_of(text)
        code = np.array([numbers.setdefault(t, len(numbers)) for t in terms], np.int32)
        term, tf = np.unique(code, return_counts=True)
        self.keys.append(key)
        self.lengths.append(len(terms))
        self.term.append(term)
        self.tf.append(tf.astype(np.int32))
        self.sizes.append(len(term))
        self.cells += len(term)

    def block(self, documents: int, total: int) -> dict:
        """The block's row: ids in order, terms (most frequent first) with their number of documents, treap."""
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i] is None, self.keys[i] if self.keys[i] is not None else 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, tf = np.concatenate(self.term), np.concatenate(self.tf).astype(np.int64)
        column = np.repeat(place, self.sizes)
        df = np.bincount(term, minlength=len(self.numbers))
        by_df = np.argsort(-df, kind="stable")
        row = np.empty(len(df), np.int64)
        row[by_df] = np.arange(len(df))
        m = np.array([length_factor(n, documents, total) if total else 50 for n in self.lengths], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, self.sizes))
        height = height_of(len(df), len(order))
        words = list(self.numbers)
        return {"keys": [self.keys[i] for i in order], "height": height, "words": zstandard.ZstdCompressor(level=1).compress(b" ".join([words[i] for i in by_df])),
                "df": packed(df[by_df].astype(np.int32)), "treap": build(row[term], column, impact, height).stored()}


@dataclass
class Index:
    """``blocks`` is a written table, ``terms`` (term, df) another; ``documents`` and ``total`` are N and L."""

    blocks: DataFrame
    terms: DataFrame
    documents: int
    total: int
    key: str


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_cells: int = BLOCK_CELLS) -> Index:
    """Index of all rows, written to the shared folder."""
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def count(batches):
        for b in batches:
            n = [len(terms_of(t)) for t in cells(b, "_text")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], ["n", "l"])
    documents, total = (int(x or 0) for x in map_batches(docs.select("_text"), count, "n long, l long").agg(F.sum("n"), F.sum("l")).first())

    def blocks(batches):
        schema = pa.schema([("keys", pa.list_(key_type)), ("height", pa.int32()), ("words", pa.binary()), ("df", pa.binary()), ("treap", pa.list_(pa.binary()))])
        held = Collector()
        for b in batches:
            for k, t in zip(cells(b, "_key"), cells(b, "_text")):
                held.add(k, t)
                if held.cells >= block_cells:
                    yield pa.RecordBatch.from_pylist([held.block(documents, total)], schema)
                    held = Collector()
        if held.keys:
            yield pa.RecordBatch.from_pylist([held.block(documents, total)], schema)
    key_type = to_arrow_type(kind)
    built = stored(map_batches(docs, blocks, f"keys array<{kind.simpleString()}>, height int, words binary, df binary, treap array<binary>"), "treaps")

    def spelled(batches):
        for b in batches:
            for words, df in zip(cells(b, "words"), cells(b, "df")):
                terms, df = unzipped(words), unpacked(df, np.int32)
                for i in range(0, len(terms), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[i:i + 50_000], pa.binary()), pa.array(df[i:i + 50_000].astype(np.int64))], ["term", "df"])
    terms = map_batches(built.select("words", "df"), spelled, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(built, terms, documents, total, key)


def unzipped(words: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(words)
    return raw.split(b" ") if raw else []


# ---------------------------------------------------------------- searches

def weighted_items(items: DataFrame, found: Index, item: str, text: str) -> DataFrame:
    """(_item, _n, terms, weights): the distinct terms of each item that a document holds. Rows with the same id are items of their own."""
    def split(batches):
        for b in batches:
            index, terms = [], []
            for i, t in enumerate(cells(b, "_text")):
                own = sorted(set(terms_of(t)))
                index += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([b.column("_item").take(pa.array(index, pa.int64())), b.column("_n").take(pa.array(index, pa.int64())), pa.array(terms, pa.binary())],
                                             ["_item", "_n", "term"])
    kind = items.schema[item].dataType.simpleString()
    rows = stored(items.select(F.col(item).alias("_item"), F.monotonically_increasing_id().alias("_n"), F.col(text).cast("string").alias("_text")), "items")
    pairs = map_batches(rows, split, f"_item {kind}, _n long, term binary")
    n = found.documents
    known = pairs.join(found.terms, "term")
    w = F.floor(1000 * F.log((F.lit(2 * n + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    return known.select("_item", "_n", F.struct("term", w.alias("w")).alias("t")).groupBy("_n").agg(
        F.first("_item").alias("_item"), F.array_sort(F.collect_list("t")).alias("ts")).select("_item", "_n", F.col("ts.term").alias("terms"), F.col("ts.w").alias("weights"))


def search(items: DataFrame, found: Index, limit: int = 50, item: str = "item_id", text: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """item, rank, key of the index, score: the ``limit`` best documents of each item with a score above 0."""
    spark, key = items.sparkSession, found.key
    kind = found.blocks.schema["keys"].dataType.elementType
    key_kind, item_kind = kind.simpleString(), items.schema[item].dataType.simpleString()
    asked = stored(weighted_items(items, found, item, text), "asked")
    size = asked.agg(F.sum(F.expr("aggregate(terms, 0l, (s, t) -> s + length(t) + 16)"))).first()[0] or 0
    parts = -(-size // item_chars)
    best = None
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("_n"), F.lit(parts)) == part) if parts > 1 else asked
        # about item_chars characters of items, whatever their number
        shared = spark.sparkContext.broadcast([(r["_n"], [bytes(t) for t in r["terms"]], r["weights"]) for r in mine.select("_n", "terms", "weights").collect()])
        rows = map_batches(found.blocks, searcher(shared, limit, kind), f"_n long, _key {key_kind}, score long")
        best = rows if best is None else best.unionAll(rows)
    if best is None:
        return spark.createDataFrame([], f"`{item}` {item_kind}, rank int, `{key}` {key_kind}, score long")
    order = Window.partitionBy("_n").orderBy(F.desc("score"), F.asc_nulls_last("_key"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.join(asked.select("_n", "_item"), "_n").select(F.col("_item").alias(item), "rank", F.col("_key").alias(key), "score")


def searcher(shared, limit: int, kind: DataType):
    """The best of each item in the blocks of one task; a block need not look below the best that the blocks before it gave."""
    key_type = to_arrow_type(kind)

    def run(batches):
        items = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        for b in batches:
            for block in b.to_pylist():
                rows = {t: i for i, t in enumerate(unzipped(block["words"]))}
                sizes, bits, drops, places = block["treap"]
                treap = Treap(Levels(block["height"], unpacked(sizes, np.int64), unpacked(bits, np.uint8), unpacked(drops, np.int32), unpacked(places, np.uint64)))
                keys = block["keys"]
                for i, (_, terms, weights) in enumerate(items):
                    here = [(rows[t], w) for t, w in zip(terms, weights) if w and t in rows]
                    if not here:
                        continue
                    row, w = (np.array(x, np.int64) for x in zip(*here))
                    floor = best[i][-1][0] if len(best[i]) == limit else 0
                    columns, scores = treap.best(row, w, limit, floor)
                    new = [(s, keys[c]) for c, s in zip(columns.tolist(), scores.tolist())]
                    if new:
                        best[i] = sorted(best[i] + new, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:limit]
        for i, own in enumerate(best):
            if own:
                yield pa.RecordBatch.from_pydict({"_n": pa.array([items[i][0]] * len(own), pa.int64()), "_key": pa.array([k for _, k in own], key_type), "score": pa.array([s for s, _ in own], pa.int64())})
    return run


def ranked(items: DataFrame, docs: DataFrame, limit: int = 50, item: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """item, rank, key, score of the ``limit`` best rows of ``docs`` for each row of ``items``."""
    return search(items, index(docs, key, text), limit, item, text)
