"""Alignment of two tokenizers' encodings of the same texts.

Each text is encoded by a byte-level tokenizer (A, a space put before the text) and by a SentencePiece model (B, which puts
that space itself). The bytes of the tokens write the text again, so the running sums of their lengths are the places where
tokens end. Where a token of A and one of B end at the same byte, a group ends. The common ends are found by galloping: each
end of the shorter list starts near its expected place in the longer one, doubles its step until it is passed, and is then found by halving;
all ends of a block of documents do so at once. The indices of the common ends in both lists slice the groups,
the differences of neighbouring indices are the numbers of tokens in them, and a group with p and q tokens holds p x q links.

How many documents hold a pair of ids linked is counted over all documents. Documents are taken in blocks, which are written
with each document's pairs (places in the block's sorted distinct pairs, and how often). A block tells each of its pairs once with its
number of documents; these rows are summed by pair, the largest sum for each A id (as many rows as A has ids at most) goes to all tasks, and
the sums go back to their blocks. So what is moved is the distinct pairs of each block, not the links; no pair of a hot word
is more than one row a block, and a lost executor costs only tasks that read written tables.

Null and empty texts, and texts that the tokens of A or B do not write again byte by byte, have no tokens: zeros and an empty
digest column. Repeated rows and repeated ids are documents of their own. Very long texts are a block by themselves and are
encoded whole; a group of many tokens is counted by distinct ids and never spread link by link. An empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsweave.llm.common import cells, held, map_batches, stored

#: Characters of a block (one document at least), and of the texts encoded at once; most links of a group that is spread.
BLOCK_CHARS, CALL_CHARS, SPREAD = 2_500_000, 200_000, 256
SPACE = "▁"
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_characters() -> dict[str, int]:
    """The characters with which byte-level tokenizers write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Encoder of a byte-level tokenizer file. Texts of Latin-1 characters, whose classes no version of Unicode changes, go through
    the ranks that the file's vocabulary gives, which are its merges in order (checked here); all others through the file's own library."""

    #: How byte-level tokenizers cut a text before they merge (a fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, file: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(file)
        self.library.encode_special_tokens = True
        written = byte_characters()
        known = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.bytes[i] = bytes(written[c] for c in token) if all(c in written for c in token) else token.encode()
        told = json.loads(file)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in told["model"]["merges"]]
        vocabulary, cut = told["model"]["vocab"], told["pre_tokenizer"] or {}
        places = [vocabulary[m] for m in merges]
        plain = told["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.lossless = told["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
        self.ranks = None
        if plain and places == sorted(places) and len(vocabulary) == 256 + len(merges) and not told["model"].get("dropout"):
            self.ranks = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        others = []
        for i, t in enumerate(texts):
            if self.ranks is not None and latin(t):
                out[i] = self.ranks.encode_to_numpy(t, disallowed_special=()).astype(np.int32)
            else:
                others.append(i)
        for i, found in zip(others, self.library.encode_batch_fast([texts[i] for i in others], add_special_tokens=False) if others else []):
            out[i] = np.array(found.ids, np.int32)
        return out


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pair:
    """Both tokenizers, with the bytes of every token and its text form in a list of groups."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        self.a, self.b = ByteLevel(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a, n = self.a.bytes, self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int32) for t in (self.bytes_a, self.bytes_b))
        # a token of A goes on with , or |, one of B with , or ; or nothing
        self.shown = [f"{i}{end}".encode() for i in range(len(self.bytes_a)) for end in (",", "|")] + [f"{i}{end}".encode() for i in range(n) for end in (",", ";", "")]
        self.shown_b = 2 * len(self.bytes_a)

    def encoded(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none for texts that they do not write again."""
        there = [t for t in texts if t]
        spaced = [" " + t for t in there]
        found = zip(spaced, self.a.encode(spaced), self.b.encode(there, num_threads=1) if there else [])
        none = np.empty(0, np.int32)
        out_a, out_b = [], []
        for t in texts:
            a = b = none
            if t:
                whole, a, ids = next(found)
                raw, table = whole.encode("utf-8", "replace"), self.bytes_b
                same = b"".join([table[i] for i in ids]) == raw and (self.a.lossless or b"".join([self.bytes_a[i] for i in a.tolist()]) == raw)
                a, b = (a, np.array(ids, np.int32)) if same else (none, none)
            out_a.append(a)
            out_b.append(b)
        return out_a, out_b


def galloped(x: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each x the first index in the sorted ``ends`` with a value not below it, from a start index on: steps that double until
    it is passed, up or down, then halving. Every x is at most the last end."""
    top = len(ends)
    low, high = np.full(len(x), -1, np.int64), np.full(len(x), top, np.int64)
    # low: known to be below x; high: known not to be
    below = ends[start] < x
    low[below], high[~below] = start[below], start[~below]
    step, open_ = 1, np.flatnonzero(below)
    while len(open_):
        at = np.minimum(start[open_] + step, top - 1)
        under = ends[at] < x[open_]
        low[open_[under]] = at[under]
        high[open_[~under]] = at[~under]
        open_, step = open_[under], 2 * step
    step, open_ = 1, np.flatnonzero(~below)
    while len(open_):
        at = np.maximum(start[open_] - step, 0)
        over = ends[at] >= x[open_]
        high[open_[over]] = at[over]
        low[open_[~over]] = at[~over]
        open_, step = open_[over & (at > 0)], 2 * step
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        under = ends[middle] < x[open_]
        low[open_[under]] = middle[under]
        high[open_[~under]] = middle[~under]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def common_ends(end_a: np.ndarray, end_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in A and B of the ends that both have. The ends are those of some documents one behind the other; n: tokens of each."""
    pairs = []
    for short, long_, n_short, n_long, mine in ((end_a, end_b, n_a, n_b, n_a <= n_b), (end_b, end_a, n_b, n_a, n_a > n_b)):
        index = np.flatnonzero(np.repeat(mine, n_short))
        if not len(index):
            pairs.append((index, index))
            continue
        first_short, first_long = np.cumsum(n_short) - n_short, np.cumsum(n_long) - n_long
        doc = np.repeat(np.arange(len(n_short)), n_short)[index]
        start = first_long[doc] + (index - first_short[doc]) * n_long[doc] // n_short[doc]
        at = galloped(short[index], long_, start)
        same = long_[at] == short[index]
        pairs.append((index[same], at[same]))
    a, b = np.concatenate([pairs[0][0], pairs[1][1]]), np.concatenate([pairs[0][1], pairs[1][0]])
    order = np.argsort(a)
    return a[order], b[order]


def doc_pairs(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, doc: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, pair of ids) as one sorted code, and how many links each has. p, q, doc: tokens and document of each group."""
    first_a, first_b = np.cumsum(p) - p, np.cumsum(q) - q
    links = p * q
    small = links <= SPREAD
    n = links[small]
    of = np.repeat(np.flatnonzero(small), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = first_a[of] + within // q[of], first_b[of] + within % q[of]
    codes, counts = [(doc[of] << 32) | (a[i].astype(np.int64) * base + b[j])], [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(~small):
        ids_a, times_a = np.unique(a[first_a[g]:first_a[g] + p[g]].astype(np.int64), return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g]:first_b[g] + q[g]], return_counts=True)
        codes.append(((doc[g] << 32) | (ids_a[:, None] * base + ids_b)).ravel())
        counts.append((times_a[:, None] * times_b).ravel())
    code, count = np.concatenate(codes), np.concatenate(counts)
    if len(codes) == 1:
        return np.unique(code, return_counts=True)
    found, where = np.unique(code, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where.ravel(), count)
    return found, total


def packed(a: np.ndarray, kind) -> bytes:
    """Numbers by byte planes, compressed."""
    a = a.astype(kind)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def aligned_block(pair: Pair, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> dict:
    """What is known of a block of documents before the counts of all documents are."""
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([*ids, np.empty(0, np.int32)]) for ids in (ids_a, ids_b))
    at_a, at_b = common_ends(np.cumsum(pair.size_a[a], dtype=np.int64), np.cumsum(pair.size_b[b], dtype=np.int64), n_a, n_b)
    p, q = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    docs = len(n_a)
    doc = np.repeat(np.arange(docs), n_a)[at_a]
    last_group = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.empty(0, bool)
    # the tokens in the order in which groups are written, each with what follows it
    sequence = np.empty(len(a) + len(b), np.int32)
    form = 2 * a
    form[at_a] += 1
    sequence[np.arange(len(a)) + np.repeat(at_b - q + 1, p)] = form
    form = pair.shown_b + 3 * b
    form[at_b] += 1 + last_group.astype(np.int32)
    sequence[np.arange(len(b)) + np.repeat(at_a + 1, q)] = form
    del form
    shown, digests, start = pair.shown, [], 0
    for n in (n_a + n_b).tolist():
        digests.append(hashlib.sha256(b"".join([shown[i] for i in sequence[start:start + n].tolist()])).hexdigest() if n else "")
        start += n
    del sequence
    code, times = doc_pairs(a, b, p, q, doc, len(pair.bytes_b))
    of_doc, of_pair = code >> 32, code & 0xFFFFFFFF
    pairs, which, held_by = np.unique(of_pair, return_inverse=True, return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc, minlength=docs), "n_links": np.bincount(doc, p * q, docs).astype(np.int64) if docs else n_a,
            "groups_sha256": digests, "pairs": packed(pairs, np.int64), "held_by": packed(held_by, np.int64), "which": packed(np.diff(which.ravel(), prepend=0), np.int32),
            "times": packed(times, np.int64), "n_pairs": np.bincount(of_doc, minlength=docs)}


def blocks_of(batches, key: str, text: str, block_chars: int):
    """(ids, texts) of blocks of documents."""
    keys, texts, size = [], [], 0
    for b in batches:
        for k, t in zip(cells(b, key), cells(b, text)):
            keys.append(k)
            texts.append(t)
            size += len(t or "")
            if size >= block_chars:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def calls_of(texts: list[str | None], chars: int = CALL_CHARS):
    """The texts in runs of about so many characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def aligned(docs: DataFrame, tokenizers: tuple[bytes, bytes], key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best (links whose pair is the one that most documents hold for its A id),
    count_sum (documents that hold the pair, summed over links), groups_sha256. ``tokenizers``: the files of A and B, as bytes."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    key_type, files, named = to_arrow_type(kind), spark.sparkContext.broadcast(tokenizers), uuid.uuid4().hex
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_pairs"]
    binaries = ["pairs", "held_by", "which", "times"]

    def run(batches):
        pair = held(named, lambda: Pair(*files.value))
        place = TaskContext.get().partitionId() << 32
        for number, (keys, texts) in enumerate(blocks_of(batches, "_key", "_text", block_chars)):
            ids_a, ids_b = [], []
            for call in calls_of(texts):
                a, b = pair.encoded(call)
                ids_a += a
                ids_b += b
            found = aligned_block(pair, ids_a, ids_b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place + number]), pa.array([keys], pa.list_(key_type)), pa.array([found["groups_sha256"]], pa.list_(pa.string())),
                 *(pa.array([found[n]], pa.list_(pa.int64())) for n in longs), *(pa.array([found[n]], pa.binary()) for n in binaries)],
                ["block", "keys", "groups_sha256", *longs, *binaries])
    blocks = stored(map_batches(rows, run, f"block long, keys array<{kind.simpleString()}>, groups_sha256 array<string>, "
                                + "".join(f"{n} array<long>, " for n in longs) + ", ".join(f"{n} binary" for n in binaries)), "aligned")

    def told(batches):
        for b in batches:
            for number, pairs, held_by in zip(cells(b, "block"), cells(b, "pairs"), cells(b, "held_by")):
                pairs, held_by = unpacked(pairs, np.int64), unpacked(held_by, np.int64)
                for i in range(0, len(pairs), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[part]), number)), pa.array(pairs[part]), pa.array(held_by[part])], ["block", "pair", "n"])
    tells = map_batches(blocks.select("block", "pairs", "held_by"), told, "block long, pair long, n long")
    counted = stored(tells.withColumn("count", F.sum("n").over(Window.partitionBy("pair"))).drop("n"), "pair-counts")
    base = len_of_b(tokenizers[1])
    a_id = F.floor(F.col("pair") / base).cast("int")
    # one row for each id of A at most
    best = counted.groupBy(a_id.alias("a")).agg(F.max("count").alias("most"))
    answers = counted.join(F.broadcast(best), a_id == F.col("a")).select("block", "pair", "count", (F.col("count") == F.col("most")).alias("best"))

    def finished(own: pa.Table, answer: pa.Table) -> pa.Table:
        out = []
        for row in own.to_pylist():
            pairs = unpacked(row["pairs"], np.int64)
            count, top = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            at = np.searchsorted(pairs, answer.column("pair").to_numpy())
            count[at], top[at] = answer.column("count").to_numpy(), answer.column("best").to_numpy(zero_copy_only=False)
            which, times = np.cumsum(unpacked(row["which"], np.int32), dtype=np.int64), unpacked(row["times"], np.int64)
            edges = np.r_[0, np.cumsum(row["n_pairs"], dtype=np.int64)]
            sums = [np.r_[0, np.cumsum(times * x[which])] for x in (top, count)]
            n_best, count_sum = (s[edges[1:]] - s[edges[:-1]] for s in sums)
            out.append(pa.table({key: pa.array(row["keys"], key_type), **{n: pa.array(row[n], pa.int64()) for n in longs[:4]},
                                 "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": pa.array(row["groups_sha256"], pa.string())}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in
                                                          [(key, key_type), *((n, pa.int64()) for n in [*longs[:4], "n_best", "count_sum"]), ("groups_sha256", pa.string())]})
    return blocks.drop("held_by").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finished, f"`{key}` {kind.simpleString()}, {RESULT}")


def len_of_b(model: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()


def default_tokenizers() -> tuple[bytes, bytes]:
    """The given files of both tokenizers; any other byte-level tokenizer file and SentencePiece model can be passed instead."""
    import public_tokenizers

    out = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            out.append(f.read())
    return out[0], out[1]
