"""Language-model scores by a weighted backoff automaton of order three.

States are histories: the two words before (bigrams of the training documents), the word before, and the empty one. A state has an arc
for every word seen after it, with the smoothed probability of that n-gram as weight and the longest history behind it as
target; a word without an arc takes the state's failure arc, which carries a weight to the state of the shorter history. The empty state has an
arc for every word. A text is read once from left to right: the state is carried along and the logarithms of the weights add up.

Smoothing is the hierarchical Dirichlet model (MacKay and Peto):

* ``P(w | h) = (c(hw) + K P(w | h')) / (c(h) + K)``, h' the history without its first word. So the failure weight is ``K / (c(h) + K)``. K, one
  for each length of history, is chosen such that the failure mass of all training positions, each left out once, equals the number of n-grams
  seen once: the sum of ``c(h) K / (c(h) - 1 + K)`` over histories is the number of singletons (Good and Turing).
* ``P(w) = max(c(w) - d, 0) / N + d V / N / (V + 1)``, ``d = n1 / (n1 + 2 n2)`` from the words seen once and twice. All unknown words are one
  word, as in the base score.

A text starts in the history of the word before it, the end of another text; the end is a word like others.

The model is never held as a whole. Documents are taken in blocks of about ``BLOCK_CHARS`` characters. A block asks for the counts of just the words,
bigrams and trigrams it has, telling its own training counts: sorted 64-bit hashes, dealt over buckets by their leading bits. The number of
buckets grows with the input, so that a bucket holds as many keys as a block whatever the input, and rows are sent for buckets only that a
block has keys for. A bucket adds up what blocks tell and answers each in the order it asked; the sums that choose K and d are added over buckets
first. The block then builds its part of the automaton and walks its documents. A frequent n-gram is one entry a block, so no bucket is hot.

Null text counts as empty: one token, the end. Null ids count as the empty text where the fold is
chosen. Repeated rows are scored alike (and learnt from as often as they stand there); an empty table
gives an empty result; very long texts are a block by themselves; no other column is looked at. The rows are read twice in the
same order: tables that come out of a shuffle are written first. The scores do not depend on how the rows lie in files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsweave.llm.common import cells, map_batches, stored

#: Characters of a block (one document at least) and for each bucket; added to every count by the base score; tokens of a walk.
BLOCK_CHARS, BUCKET_CHARS, ADDED, STRIDE = 5_000_000, 5_000_000, 0.1, 512
#: Values of K for which the buckets sum up failure masses.
PRIORS = np.logspace(-3, 7, 61)
#: Low bits of a key: word, bigram that may be a history, bigram that ends a text, trigram.
WORD, HISTORY, ENDING, TRIPLE = (np.uint64(i) for i in range(4))
END, ODD_A, ODD_B = b"", np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def in_fold(key, folds: int) -> bool:
    """Whether crc32 of the key's text is divisible by the number of folds: such a document is held out."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds == 0


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, words between ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def packed(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread over all bits, so that leading bits deal evenly."""
    x = (x ^ (x >> np.uint64(31))) * ODD_B
    return x ^ (x >> np.uint64(29))


def marked(x: np.ndarray, mark) -> np.ndarray:
    return (x & ~np.uint64(3)) | mark


class Block:
    """Words of some documents by number (0 is the end of a text), their n-grams by number, and the keys under which it asks for counts."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray):
        self.hashes, self.tokens, self.lengths, n = hashes, tokens, lengths, len(hashes)
        self.starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        before = np.r_[np.int64(0), tokens[:-1].astype(np.int64)]
        # the word before the first of a text is the end of another, which needs no number of its own
        self.pairs, self.pair_of = numbered_once(before * n + tokens)
        self.before, self.word = self.pairs // n, self.pairs % n
        # a trigram is the bigram one position earlier and a word; the first token of a text has none
        earlier = np.r_[0, self.pair_of[:-1]]
        self.has_triple = np.ones(len(tokens), bool)
        self.has_triple[self.starts] = False
        triples, of = numbered_once((earlier.astype(np.int64) * n + tokens)[self.has_triple])
        self.triple_of = np.zeros(len(tokens), np.int32)
        self.triple_of[self.has_triple] = of
        self.history, self.last = (triples // n).astype(np.int32), (triples % n).astype(np.int32)
        mixed_words = mixed(hashes)
        double = mixed(mixed(hashes[self.before] * ODD_A) + mixed_words[self.word])
        triple = mixed(mixed(double[self.history] * ODD_A) + mixed_words[self.last])
        keys = np.concatenate([marked(mixed_words, WORD), marked(double, np.where(self.word == 0, ENDING, HISTORY)), marked(triple, TRIPLE)])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def mark(self) -> int:
        """What tells this block from one with other words or in another order."""
        return xxhash.xxh64_intdigest(self.keys.tobytes()) >> 1

    def asked(self, train: np.ndarray) -> np.ndarray:
        """Training counts of the block by key. ``train``: for each document."""
        mask = np.repeat(train, self.lengths)
        return np.concatenate([np.bincount(self.tokens[mask], minlength=len(self.hashes)), np.bincount(self.pair_of[mask], minlength=len(self.pairs)),
                               np.bincount(self.triple_of[mask & self.has_triple], minlength=len(self.last))])[self.order].astype(np.uint32)

    def counts(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words, bigrams and trigrams from sums in the order of the keys."""
        by_entry = np.empty(len(sums), np.int64)
        by_entry[self.order] = sums
        return tuple(np.split(by_entry, [len(self.hashes), len(self.hashes) + len(self.pairs)]))


def numbered_once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the number of each."""
    found, of = np.unique(x, return_inverse=True)
    return found, of.ravel().astype(np.int32)


def read_blocks(batches, key: str, text: str, block_chars: int):
    """(keys, words of each document) of blocks of documents."""
    keys, docs, size = [], [], 0
    for b in batches:
        for k, t in zip(cells(b, key), cells(b, text)):
            keys.append(k)
            docs.append(t)
            size += len(t or "")
            if size >= block_chars:
                yield keys, docs
                keys, docs, size = [], [], 0
    if keys:
        yield keys, docs


def numbered(docs: list[str | None]) -> Block:
    numbers: dict[bytes, int] = {END: 0}
    tokens, lengths = [], []
    for t in docs:
        words = words_of(t)
        found = [numbers.setdefault(w, len(numbers)) for w in words]
        tokens.append(np.array([*found, 0], np.uint32))
        lengths.append(len(found) + 1)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
    return Block(hashes, np.concatenate(tokens), np.array(lengths, np.int64))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the sorted keys starts, and the end."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.r_[0, np.searchsorted(keys, np.array(edges, np.uint64)), len(keys)]


# ---------------------------------------------------------------- the exchange

#: What a bucket sums up: tokens, words, words seen once and twice, bigrams and trigrams seen once, failure masses of both histories for each K.
SUMS = 6 + 2 * len(PRIORS)


def failure_mass(counts: np.ndarray) -> np.ndarray:
    """Of histories with these counts, for each K."""
    value, times = np.unique(counts, return_counts=True)
    return np.array([(times * value * k / (value - 1 + k)).sum() for k in PRIORS])


def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    kind, seen = keys & np.uint64(3), counts > 0
    one, history, triple = (counts[seen & (kind == k)] for k in (WORD, HISTORY, TRIPLE))
    ending = counts[seen & (kind == ENDING)]
    return np.concatenate([[one.sum(), len(one), (one == 1).sum(), (one == 2).sum(), (history == 1).sum() + (ending == 1).sum(), (triple == 1).sum()],
                           failure_mass(one), failure_mass(history)]).astype(np.float64)


def answer(rows: pa.Table) -> pa.Table:
    """Sums of one bucket for each block that asked it, and in a row without a block the bucket's own totals."""
    asked = [unpacked(x, np.uint64).cumsum(dtype=np.uint64) for x in rows.column("asked").to_pylist()]
    told = [unpacked(x, np.uint32) for x in rows.column("told").to_pylist()]
    keys, where = np.unique(np.concatenate(asked), return_inverse=True)
    sums = np.bincount(where.ravel(), np.concatenate(told), len(keys)).astype(np.int64)
    ends = np.cumsum([len(a) for a in asked])
    found = [packed(sums[where[e - len(a):e]].astype(np.uint64)) for a, e in zip(asked, ends)]
    bucket = rows.column("bucket").to_pylist()
    return pa.table({"block": pa.array([*rows.column("block").to_pylist(), None], pa.int64()), "bucket": pa.array([*bucket, bucket[0]], pa.int32()),
                     "mark": pa.array([*rows.column("mark").to_pylist(), None], pa.int64()), "sums": pa.array([*found, None], pa.binary()),
                     "totals": pa.array([None] * len(found) + [totals(keys, sums).tolist()], pa.list_(pa.float64()))})


# ---------------------------------------------------------------- the automaton

class Smoothing:
    """Numbers of the whole corpus: tokens, words, d and K by length of history."""

    def __init__(self, sums: np.ndarray):
        self.tokens, self.words, once, twice, pairs_once, triples_once = sums[:6]
        self.d = float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once + twice else 0.5
        self.k = [prior(mass, seen) for mass, seen in zip(np.split(sums[6:], 2), (pairs_once, triples_once))]

    def word(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts, an unknown one with 0."""
        if not self.tokens:
            return np.ones(len(c))
        return np.maximum(c - self.d, 0) / self.tokens + self.d * self.words / self.tokens / (self.words + 1)


def prior(mass: np.ndarray, once: float) -> float:
    """K at which the failure mass is the number of singletons; the masses rise with K."""
    return float(np.exp(np.interp(once, mass, np.log(PRIORS)))) if mass[-1] > 0 else 1.0


class Automaton:
    """A block's part of the automaton, in arrays. States by number: bigrams, then words, then the empty history. Arcs by the
    n-gram they read; ``target`` is the state behind a bigram or a word, that of the longest history with a count."""

    def __init__(self, block: Block, counts: tuple[np.ndarray, np.ndarray, np.ndarray], smooth: Smoothing):
        one, two, three = counts
        pairs, words = len(two), len(one)
        self.words_at, self.empty = pairs, pairs + words
        word = smooth.word(one)
        k1, k2 = smooth.k
        # failure arcs: to the word behind a bigram, to the empty history behind a word
        self.fail_to = np.concatenate([pairs + block.word, np.full(words + 1, self.empty)]).astype(np.int32)
        with np.errstate(divide="ignore"):
            self.fail = np.concatenate([np.log10(k2 / (two + k2)), np.log10(k1 / (one + k1)), [0.0]])
            after = np.where(one[block.before] > 0, (two + k1 * word[block.word]) / (one[block.before] + k1), word[block.word])
            below = self.pair_value(after, block)
            three_value = (three + k2 * below) / (two[block.history] + k2)
            self.arc1, self.arc2, self.arc3 = np.log10(word), np.log10(after), np.log10(three_value)
        self.seen2, self.seen3 = two > 0, three > 0
        self.state_of_word = np.where(one > 0, pairs + np.arange(words), self.empty).astype(np.int32)
        #: Behind a bigram: its own state, or that of its last word.
        self.state_of_pair = np.where(self.seen2, np.arange(pairs), self.state_of_word[block.word]).astype(np.int32)

    @staticmethod
    def pair_value(after: np.ndarray, block: Block) -> np.ndarray:
        """P(w | v) for the last two words of each trigram."""
        n = len(block.hashes)
        return after[np.searchsorted(block.pairs, block.word[block.history] * n + block.last)]

    def walk(self, block: Block, stride: int = STRIDE) -> np.ndarray:
        """Log-probability of each document. All documents are walked side by side, a long one in parts of ``stride`` tokens, each
        from the state that the words before it lead to."""
        heads = np.concatenate([np.arange(s, s + n, stride) for s, n in zip(block.starts.tolist(), block.lengths.tolist())])
        doc = np.repeat(np.arange(len(block.starts)), -(-block.lengths // stride))
        ends = np.minimum(heads + stride, (block.starts + block.lengths)[doc])
        order = np.argsort(-(ends - heads), kind="stable")
        heads, ends, doc = heads[order], ends[order], doc[order]
        # behind the end of another text for a first part, else behind the token before
        first = heads == block.starts[doc]
        state = np.where(first, self.state_of_word[0], self.state_of_pair[block.pair_of[heads - 1]])
        total, at = np.zeros(len(heads)), heads.copy()
        active = len(heads)
        while active:
            now, s = at[:active], state[:active]
            pair, triple = block.pair_of[now], block.triple_of[now]
            gain, behind = np.zeros(active), np.empty(active, np.int32)
            waiting = np.arange(active)
            # an arc of the state, or its failure arc, until an arc is found
            for _ in range(3):
                here = s[waiting]
                deep, middle = here < self.words_at, (here >= self.words_at) & (here < self.empty)
                arc3 = deep & self.seen3[triple[waiting]] if len(self.seen3) else np.zeros(len(waiting), bool)
                arc2 = middle & self.seen2[pair[waiting]]
                arc1 = here == self.empty
                w = waiting[arc3]
                gain[w] += self.arc3[triple[w]]
                behind[w] = self.state_of_pair[pair[w]]
                w = waiting[arc2]
                gain[w] += self.arc2[pair[w]]
                behind[w] = self.state_of_pair[pair[w]]
                w = waiting[arc1]
                gain[w] += self.arc1[block.tokens[now[w]]]
                behind[w] = self.state_of_word[block.tokens[now[w]]]
                waiting = waiting[~(arc3 | arc2 | arc1)]
                gain[waiting] += self.fail[s[waiting]]
                s = s.copy()
                s[waiting] = self.fail_to[s[waiting]]
                if not len(waiting):
                    break
            total[:active] += gain
            state[:active] = behind
            at[:active] += 1
            while active and at[active - 1] >= ends[active - 1]:
                active -= 1
        return np.bincount(doc, total, len(block.starts))


def fixed(docs: DataFrame) -> DataFrame:
    """``docs`` in an order that a second reading repeats: what comes out of a shuffle is written first."""
    return stored(docs, "documents") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, block_chars: int = BLOCK_CHARS, buckets: int | None = None) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10). Documents that are
    not held out are learnt from."""
    kind = docs.schema[key].dataType
    key_type, key_kind = to_arrow_type(kind), kind.simpleString()
    docs = fixed(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")))
    chars = docs.agg(F.sum(F.length("_text"))).first()[0] or 0
    buckets = buckets or max(1, -(-chars // BUCKET_CHARS))

    def blocks(batches):
        place = TaskContext.get().partitionId() << 32
        for i, (keys, texts) in enumerate(read_blocks(batches, "_key", "_text", block_chars)):
            yield place + i, keys, numbered(texts)

    def ask(batches):
        for number, keys, block in blocks(batches):
            told = block.asked(np.array([not in_fold(k, folds) for k in keys], bool))
            at = bucket_bounds(block.keys, buckets)
            there = np.flatnonzero(np.diff(at))
            cut = [slice(at[i], at[i + 1]) for i in there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), number)), pa.array(there.astype(np.int32)),
                 pa.array([packed(np.diff(block.keys[s], prepend=np.uint64(0))) for s in cut], pa.binary()),
                 pa.array([packed(told[s]) for s in cut], pa.binary()), pa.array(np.full(len(there), block.mark()))], ["block", "bucket", "asked", "told", "mark"])

    def tell(batches):
        for number, keys, block in blocks(batches):
            texts = pa.array([[packed(block.hashes), packed(block.tokens), packed(block.lengths)]], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), texts, pa.array([keys], pa.list_(key_type))], ["block", "bucket", "texts", "keys"])

    asks = map_batches(docs, ask, "block long, bucket int, asked binary, told binary, mark long")
    answers = stored(asks.groupBy("bucket").applyInArrow(answer, "block long, bucket int, mark long, sums binary, totals array<double>"), "answers")
    columns = [F.sum(F.col("totals")[i]) for i in range(SUMS)]
    smooth = Smoothing(np.array([x or 0.0 for x in answers.where("block is null").agg(*columns).first()]))

    def scored(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        own, found = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        if own["bucket"] != -1:
            raise RuntimeError("the documents were read in other blocks than when they asked")
        hashes, tokens, lengths = (unpacked(x, t) for x, t in zip(own["texts"], (np.uint64, np.uint32, np.int64)))
        block = Block(hashes, tokens, lengths)
        if set(found.column("mark").to_pylist()) != {block.mark()}:
            raise RuntimeError("the documents came in another order than when they asked")
        counts = block.counts(np.concatenate([unpacked(x, np.uint64) for x in found.column("sums").to_pylist()]))
        c = counts[0]
        base = np.log10((c + ADDED) / (smooth.tokens + ADDED * (smooth.words + 1)))

        def per_text(values):
            return np.add.reduceat(values[tokens], block.starts)
        return pa.table({
            key: pa.array(own["keys"], key_type), "held_out": pa.array([in_fold(k, folds) for k in own["keys"]]), "n_tokens": pa.array(lengths),
            "n_known": pa.array(per_text((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(lengths), int(smooth.tokens))),
            "base_score": pa.array(per_text(base)), "score": pa.array(Automaton(block, counts, smooth).walk(block))})

    own = map_batches(docs, tell, f"block long, bucket int, texts array<binary>, keys array<{key_kind}>")
    together = own.unionByName(answers.where("block is not null").drop("totals"), allowMissingColumns=True)
    return together.groupBy("block").applyInArrow(scored, f"`{key}` {key_kind}, {RESULT}")
