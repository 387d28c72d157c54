"""SimHash near-duplicate groups, found through a Gray-order hierarchical index.

A document's fingerprint has 64 bits; bit b is set if it is set in over half of the hashes of
its word shingles (repeats count). Two fingerprints are linked if at most ``DISTANCE`` bits
differ; linked fingerprints form groups, each named by the smallest document id in it.

How links are found:

* Only distinct fingerprints are compared; copies are collapsed first, with map-side combine.
* Two fingerprints with at most d differing bits agree on one of d + 1 blocks of bits, so each
  fingerprint goes to d + 1 groups, one per block value. A group with more than ``GROUP_ROWS``
  members is split again in the same way over its remaining bits, which loses no link. After
  ``LEVELS`` splits at most 2^19 fingerprints can share a group, whatever the input.
* In a group the fingerprints are sorted by Gray rank, where neighbours share bit patterns.
  Runs of ``FAN`` neighbours become nodes, runs of nodes upper nodes. Each node holds the bits
  on which all below it agree, without those that a node above already holds. A search goes
  down from the top and adds up the differences; a node whose sum exceeds the distance is
  left with all that is below it.
* Of the links in a group only a spanning forest leaves the task: as many rows as fingerprints
  at most, and the same groups. The groups of all are found by repeated large-star and
  small-star steps, in the shared folder between steps.

Null and empty texts have fingerprint zero, linked like any other. Repeated ids are repeated
rows of the result; a null id can't name a group unless all in it are null. Very long
texts are read whole. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.common import cells, map_batches, stored

DISTANCE, SHINGLE = 2, 3
#: Members of a node, rows from which on a group is split again, times it may be split.
FAN, GROUP_ROWS, LEVELS = 16, 50_000, 3
#: Searches done at once, which bounds the memory for open nodes.
SEARCHES = 2048
BITS = 64


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = 42) -> int:
    """Fingerprint of a whole text: A-Z lower-cased, words between ASCII white space."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-words].tolist()]
    hashed, view = xxhash.xxh64_intdigest, memoryview(joined)
    found = np.array([hashed(view[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], np.uint64)
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 65536):
        total += np.unpackbits(found[i:i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """key and ``fp``: the fingerprint as a signed 64-bit integer."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in cells(b, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fps)], [key, "fp"])
    return map_batches(docs.select(key, F.col(text).cast("string").alias(text)), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


# ---------------------------------------------------------------- groups of fingerprints that may be linked

def bit_blocks(free: list[int], parts: int) -> list[list[int]]:
    """``free`` bit numbers in ``parts`` runs of nearly equal length."""
    return [free[i * len(free) // parts:(i + 1) * len(free) // parts] for i in range(parts)]


def paths(level: int, parts: int) -> list[tuple[int, list[int]]]:
    """(number, bits) of each choice of blocks on a level: a choice of the level above and one more block of its free bits."""
    found = [(0, [])]
    for _ in range(level):
        found = [(n * (parts + 1) + i + 1, bits + block) for n, bits in found
                 for i, block in enumerate(bit_blocks([b for b in range(BITS) if b not in bits], parts))]
    return found


def grouped(distinct: DataFrame, distance: int, group_rows: int, levels: int) -> DataFrame:
    """(path, value, fp): the groups in which links are looked for. ``distinct`` has the column fp."""
    parts, open_rows, done = distance + 1, distinct.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("value"), "fp"), []
    for level in range(1, levels + 1):
        split = None
        choices = F.array(*[F.struct(F.lit(n // (parts + 1)).alias("above"), F.lit(n).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(bits))).alias("value"))
                            for n, bits in paths(level, parts)])
        split = (open_rows.select("fp", F.explode(F.filter(choices, lambda c: c["above"] == F.col("path"))).alias("c"))
                 .select(F.col("c.path").alias("path"), F.col("c.value").alias("value"), "fp"))
        if level == levels:
            done.append(split)
            break
        large = split.groupBy("path", "value").count().where(F.col("count") > group_rows).select("path", "value")
        large = stored(large, "simhash-large")
        if large.isEmpty():
            done.append(split)
            break
        done.append(split.join(large, ["path", "value"], "left_anti"))
        open_rows = split.join(large, ["path", "value"], "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


# ---------------------------------------------------------------- the index of one group

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class GrayIndex:
    """Nodes over Gray-sorted codes; ``mask`` and ``value`` of a node are the bits it adds to those of the nodes above."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.codes, self.fan, self.levels = codes[np.argsort(gray_rank(codes), kind="stable")], fan, []
        same, value = np.full(len(codes), ~np.uint64(0)), self.codes
        shared = []
        while True:
            shared.append((same, value))
            if len(value) <= fan:
                break
            at = np.arange(0, len(value), fan)
            both, either = np.bitwise_and.reduceat(value, at), np.bitwise_or.reduceat(value, at)
            same = np.bitwise_and.reduceat(same, at) & ~(both ^ either)
            value = both & same
        above = np.zeros(len(value), np.uint64)
        for same, value in reversed(shared):
            own = same & ~above[:len(value)]
            self.levels.append((own, value & own))
            above = same if len(value) == len(self.codes) else np.repeat(same, fan)

    def near(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place): all pairs within the distance, places in Gray order."""
        n = len(self.levels[0][0])
        who, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        so_far = np.zeros(len(who), np.int16)
        for depth, (mask, value) in enumerate(self.levels):
            so_far = so_far + ones((queries[who] ^ value[node]) & mask[node])
            kept = so_far <= distance
            who, node, so_far = who[kept], node[kept], so_far[kept]
            if depth + 1 < len(self.levels):
                below = len(self.levels[depth + 1][0])
                who, so_far = np.repeat(who, self.fan), np.repeat(so_far, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                there = node < below
                who, node, so_far = who[there], node[there], so_far[there]
        return who, node


def forest(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct codes, each tree as links to its smallest member."""
    index = GrayIndex(codes)
    codes = index.codes
    root = np.arange(len(codes))
    for start in range(0, len(codes), SEARCHES):
        block = codes[start:start + SEARCHES]
        who, place = index.near(block, distance)
        joined(root, who + start, place)
    signed_codes = codes.view(np.int64)
    least = np.full(len(codes), np.iinfo(np.int64).max)
    np.minimum.at(least, root, signed_codes)
    least = least[root]
    moved = least != signed_codes
    return signed_codes[moved], least[moved]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join sets in ``root`` (each member points to the smallest place of its set) along the links a-b."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root[:] = root[root]


def links(distinct: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS, levels: int = LEVELS) -> DataFrame:
    """(a, b), a > b: links that connect the same fingerprints as all links do. ``distinct`` has distinct values of fp."""
    groups = grouped(distinct, distance, group_rows, levels).repartition("path", "value").sortWithinPartitions("path", "value")

    def run(batches):
        held = None
        for b in [*batches_or_none(batches)]:
            rows = held
            if b is not None:
                new = tuple(b.column(n).to_numpy(zero_copy_only=False) for n in ("path", "value", "fp"))
                rows = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            if rows is None or not len(rows[0]):
                continue
            path, value, fp = rows
            starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (value[1:] != value[:-1])])
            # the last group may go on in the next batch
            whole = len(fp) if b is None else starts[-1]
            held = None if b is None else tuple(x[whole:] for x in rows)
            ends = np.r_[starts[1:], len(fp)]
            out = [forest(fp[s:e].view(np.uint64), distance) for s, e in zip(starts, ends) if e - s > 1 and e <= whole]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], ["a", "b"])
    return map_batches(groups, run, "a long, b long").where("a != b").distinct()


def batches_or_none(batches):
    """The batches as they come, and None after the last."""
    yield from batches
    yield None


# ---------------------------------------------------------------- connected groups

def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it is connected with. Alternates large-star and
    small-star steps until nothing changes; each step groups by node with map-side combine and joins on it."""
    edges = stored(edges.select("a", "b").where("a != b"), "links")
    state = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.where("a != b").distinct(), "small-star")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
    raise RuntimeError(f"no end after {rounds} rounds of star steps")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, words: int = SHINGLE) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: the smallest key of the group, itself included."""
    prints = stored(fingerprints(docs, key, text, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(distinct.select("fp"), distance))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = stored(named.join(group, "root").select("fp", "component_id"), "print-groups")
    return prints.join(of_print, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, words: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one row of each group: that with the smallest key."""
    return first_of_each(docs, near_duplicates(docs, key, text, distance, words), key)


def first_of_each(docs: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one row of each of the ``groups`` (key, component_id): that with the smallest key. Rows with the same key
    are judged as one: the key stays if it is the smallest of the group of any of them, and then the least of its rows stays."""
    found = groups.groupBy(F.col(key).alias("_key")).agg(
        F.max(F.col(key).eqNullSafe(F.col("component_id"))).alias("_stays"), F.count("*").alias("_rows"))
    # only what is not a single row that stays
    found = stored(found.where("not _stays or _rows > 1").select("_key", "_stays"), "verdicts")
    judged = docs.join(found, docs[key].eqNullSafe(found["_key"]), "left")
    single = judged.where("_stays is null").select(*docs.columns)
    if found.where("_stays").isEmpty():
        return single
    return single.unionByName(judged.where("_stays").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*"))
