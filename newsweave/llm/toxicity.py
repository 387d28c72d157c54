"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text. A window of a
text is compressed with the ordinary dictionary, and with the toxic one put in front of it; by
how many bytes the second is shorter is the window's gain. Both have the same length (the
first is filled up with bytes that no text has), so that ordinary windows gain nothing.

A labelled document is mostly ordinary text, whatever its label. The toxic dictionary is
therefore trained on those stretches of toxic documents that set them apart: runs of character
sequences whose number of different contexts in toxic documents is beyond chance (likelihood
ratio) and many times that in ordinary ones. A sequence is counted once per context (word
before, word, word after), so that copies of one document count once.

Scoring reads whole texts. Every window of ``WIDE`` words is compressed fast; the words of windows that gain are compressed one by one, as
windows of one word, with a fast and a thorough search. How many distinct words of a document reach each of the gains ``GAINS``, as such and among a
thousand words, is weighed by a logistic fit over the labelled rows, so that several small gains count and a long ordinary
document is not marked for one. Calibration: the share of toxic documents at each level of this evidence gives the score.

Only the label decides what is learnt; labels, ids, languages and sources are no part of a score.
A bounded sample is learnt from: at most ``TRAIN_ROWS`` labelled rows of each class, those with the
smallest hash of their text. Without rows of both classes every text scores 0 (nothing to tell).
Null and empty texts have no window and score the least that the calibration gives. Repeated
rows, ties and further columns have no effect on other rows; empty tables give empty results.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm.common import cells, map_batches, once, schema_of, stored, with_columns

#: Most labelled rows of each class that are learnt from, and most characters of them in all
#: (beyond one text, which is never cut).
TRAIN_ROWS, TRAIN_CHARS = 4000, 8_000_000
#: Windows of ordinary text from which the ordinary dictionary is made (a random sample of those of the rows above).
TRAIN_WINDOWS = 50_000
#: Words of a wide window; characters of a sequence; least likelihood ratio, contexts and factor that set it apart.
WIDE, RUN, RATIO, CONTEXTS, FACTOR = 8, 5, 30.0, 3, 10.0
#: Rows that the logistic curve counts for at each gain.
PRIOR = 4.0
#: Bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
#: Bytes that no UTF-8 text has, in a row that repeats nowhere: what every anchored word starts from.
ANCHOR = bytes(range(192, 240))
WINDOWS = re.compile(rb"(?:[^\s]{1,48}+\s*+){1,%d}+" % WIDE)
#: Search effort of zstandard for wide windows and words, and for words once more.
FAST, THOROUGH = zstandard.STRATEGY_LAZY2, zstandard.STRATEGY_BTULTRA2


def runs_of(word: str) -> list[tuple[int, str]]:
    """(place, sequence) of the character sequences of a word between spaces: its beginnings, and what lies behind them. A beginning is a
    sequence of its own, as most that tells at the start of a word is common inside others."""
    word = f" {word} "
    starts = [(0, word[:n]) for n in range(RUN, RUN + 3) if n < len(word)] or [(0, word)]
    return starts + [(i, word[i:i + RUN]) for i in range(2, len(word) - RUN + 1)]


def contexts(texts: list[str]) -> tuple[Counter, int]:
    """For each character sequence in how many different contexts it stands; the number of contexts."""
    seen: set[int] = set()
    found: Counter = Counter()
    for t in texts:
        words = t.lower().split()
        for context in zip(["", *words], words, [*words[1:], ""]):
            known = hash(context)
            if known not in seen:
                seen.add(known)
                found.update({run for _, run in runs_of(context[1])})
    return found, len(seen)


def telling(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Sequences that set toxic documents apart."""
    (a, n), (b, m) = contexts(toxic), contexts(ordinary)

    def fit(k, of, p):
        return k * math.log(p) + (of - k) * math.log(1 - p) if 0 < p < 1 else 0.0

    kept = set()
    for run, k in a.items():
        if k >= CONTEXTS and k * m > FACTOR * b[run] * n:
            p = (k + b[run]) / (n + m)
            if 2 * (fit(k, n, k / n) + fit(b[run], m, b[run] / m) - fit(k, n, p) - fit(b[run], m, p)) >= RATIO:
                kept.add(run)
    return kept


def stretches(text: str, runs: set[str]) -> list[bytes]:
    """The parts of the words of a text that the sequences cover."""
    out = []
    for word in text.lower().split():
        covered = bytearray(len(word) + 2)
        for i, run in runs_of(word):
            if run in runs:
                covered[i:i + len(run)] = b"\1" * len(run)
        word = f" {word} "
        out += ["".join(word[m.start():m.end()]).encode("utf-8", "replace") for m in re.finditer(rb"\x01+", covered)]
    return out


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary; too few samples for the trainer are used as they are, without repeats."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def compressor(content: bytes, strategy: int):
    settings = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=15, chain_log=16, search_log=5, min_match=3, target_length=64, strategy=strategy,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    trained = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings).compress


#: Largest gain of a word that is told apart, gains whose words are counted, levels of a document's evidence for the calibration, folds.
MOST, GAINS, LEVELS, FOLDS = 40, (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13), 80, 4


class Meter:
    """Gains of texts under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        rng = random.Random(0)
        filled = bytes(rng.randrange(240, 256) for _ in range(len(toxic)))
        self.wide = compressor(filled + ordinary, FAST), compressor(toxic + ordinary, FAST)
        self.word = [(compressor(filled + ordinary, s), compressor(toxic + ordinary, s)) for s in (FAST, THOROUGH)]
        self.known: dict[bytes, int] = {}

    def gain(self, word: bytes) -> int:
        """Bytes that a window of one word gains, by both searches together."""
        found = self.known.get(word)
        if found is None:
            anchored = b" " + word + b" " + ANCHOR
            found = min(MOST, sum(max(0, len(p(anchored)) - len(t(anchored))) for p, t in self.word))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def gains(self, text: str | None) -> np.ndarray:
        """How many of the distinct words of a text gain 0, 1, .. ``MOST`` bytes. Words of wide windows that gain nothing gain nothing."""
        plain, toxic = self.wide
        raw = (text or "").lower().encode("utf-8", "replace")
        close: set[bytes] = set()
        for window in WINDOWS.findall(raw):
            padded = b" " + window + b" "
            if len(plain(padded)) > len(toxic(padded)):
                close.update(window.split())
        counts = np.bincount([self.gain(w) for w in close], minlength=MOST + 1) if close else np.zeros(MOST + 1, np.int64)
        counts[0] += len(set(raw.split())) - len(close)
        return np.maximum(counts, 0)


def pooled(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising values nearest to ``share``: neighbours that fall are pooled by weight."""
    pools: list[list[float]] = []
    for x, w in zip(share.tolist(), weight.tolist()):
        pools.append([w * x, w, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([t / n for t, n, times in pools for _ in range(int(times))])


def looks(counts: np.ndarray) -> np.ndarray:
    """What the counts of gains of documents say: of each threshold of ``GAINS`` how many words reach it, as such and among a
    thousand; the number of words; a constant."""
    words = counts.sum(axis=1)[:, None]
    reached = np.stack([counts[:, g:].sum(axis=1) for g in GAINS], axis=1)
    return np.hstack([np.log1p(reached), np.sqrt(1000 * reached / (words + 50)), np.log1p(words), np.ones((len(counts), 1))])


def logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Weights that make the labels likely, kept small by a quadratic penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
    return w


def level(evidence: float) -> int:
    """Step of a document's summed evidence: half a unit each, 0 at -10 and below."""
    return int(min(LEVELS, max(0.0, 2 * (evidence + 10))))


def calibrated(levels: list[int], labels: list[int], most: int = LEVELS) -> list[float]:
    """Probability of a toxic document for each level from 0 to ``most``: the share of toxic rows at each, held to a logistic curve
    (as ``PRIOR`` rows more) where rows are few, and not falling: neighbours that fall are pooled."""
    y = np.array(labels, float)
    w = logistic(np.column_stack([np.ones(len(levels)), np.minimum(levels, most) / 10]), y, np.array([1e-3, 1e-2]))
    curve = 1 / (1 + np.exp(-np.clip(w[0] + max(w[1], 0.0) * np.arange(most + 1) / 10, -30, 30)))
    at = np.minimum(levels, most)
    n = np.bincount(at, minlength=most + 1) + PRIOR
    return pooled((np.bincount(at, y, most + 1) + PRIOR * curve) / n, n).tolist()


def trained(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary dictionary, toxic dictionary) from texts."""
    runs = telling(toxic, ordinary)
    parts = [s for x in toxic for s in stretches(x, runs)]
    random.Random(1).shuffle(parts)
    plain = [w for x in ordinary for w in WINDOWS.findall(x.lower().encode("utf-8", "replace"))]
    random.Random(1).shuffle(plain)
    samples = [b"".join(parts[i:i + 8]) for i in range(0, len(parts), 8)]
    return dictionary(plain[:TRAIN_WINDOWS], ORDINARY_BYTES, 48) if plain else b"", dictionary(samples, TOXIC_BYTES, 16) if samples else b""


def fold_gains(toxic: list[str], ordinary: list[str], fold: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts of gains, labels) of the texts of one fold under dictionaries that are trained on the others."""
    texts = (ordinary, toxic)
    meter = Meter(*trained(*([t for i, t in enumerate(texts[y]) if i % FOLDS != fold] for y in (1, 0))))
    counts = [[meter.gains(t) for t in texts[y][fold::FOLDS]] for y in (0, 1)]
    return np.array([*counts[0], *counts[1]]).reshape(-1, MOST + 1), np.repeat([0, 1], [len(counts[0]), len(counts[1])])


def combined(content: tuple[bytes, bytes], counts: np.ndarray, labels: np.ndarray):
    """The model: dictionaries, weights of what the gains say, score by level of the evidence."""
    x = looks(counts)
    penalty = np.ones(x.shape[1])
    penalty[-1] = 1e-6
    weights = logistic(x, labels.astype(float), penalty)
    return *content, tuple(weights.tolist()), tuple(calibrated([level(e) for e in x @ weights], labels.tolist()))


def fit(toxic: list[str], ordinary: list[str], spark: SparkSession | None = None) -> tuple[bytes, bytes, tuple[float, ...], tuple[float, ...]]:
    """(ordinary dictionary, toxic dictionary, weights, score by level of a document). Gains for weights and calibration are taken on folds:
    the dictionaries that score one are trained on the others. With a session the folds are tasks; the texts, which ``train`` bounds, are broadcast."""
    if not toxic or not ordinary:
        return b"", b"", (0.0,) * (2 * len(GAINS) + 2), (0.0,) * (LEVELS + 1)
    if min(len(toxic), len(ordinary)) < FOLDS:
        content = trained(toxic, ordinary)
        meter = Meter(*content)
        return combined(content, np.array([meter.gains(t) for t in [*toxic, *ordinary]]), np.repeat([1, 0], [len(toxic), len(ordinary)]))
    if spark is None:
        parts, content = [fold_gains(toxic, ordinary, f) for f in range(FOLDS)], trained(toxic, ordinary)
    else:
        shared = spark.sparkContext.broadcast((toxic, ordinary))

        def run(batches):
            for b in batches:
                for fold in cells(b, "id"):
                    if fold == FOLDS:
                        found = [*trained(*shared.value)]
                    else:
                        found = [x.astype(np.int64).tobytes() for x in fold_gains(*shared.value, fold)]
                    yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([found], pa.list_(pa.binary()))], ["fold", "found"])
        rows = {r["fold"]: r["found"] for r in map_batches(spark.range(0, FOLDS + 1, 1, FOLDS + 1), run, "fold long, found array<binary>").collect()}
        shared.unpersist()
        content = tuple(bytes(x) for x in rows[FOLDS])
        parts = [(np.frombuffer(rows[f][0], np.int64).reshape(-1, MOST + 1), np.frombuffer(rows[f][1], np.int64)) for f in range(FOLDS)]
    return combined(content, *(np.concatenate(x) for x in zip(*parts)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None):
    """Fit on a bounded sample of the labelled rows: per class those with the smallest hash of their text, repeated texts once."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_toxic"))
    rows = (docs.where(learn) if learn is not None else docs).select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"),
                                                                     F.xxhash64(text).alias("_hash")).where("length(_text) > 0")
    # ids, hashes and lengths tell which texts are within the bounds; only these texts are moved
    narrow = stored(rows.select("_id", "_hash", F.length("_text").alias("_n")).join(marked, F.col("_id") == F.col("_key")).select("_id", "_hash", "_n", "_toxic"), "labelled")
    chosen = []
    for y in (1, 0):
        chars = 0
        for r in narrow.where(F.col("_toxic") == y).groupBy("_hash").agg(F.min("_id").alias("_id"), F.max("_n").alias("_n")).orderBy("_hash").limit(TRAIN_ROWS).collect():
            if chars and chars + r["_n"] > TRAIN_CHARS:
                continue
            chosen.append((r["_id"], r["_hash"], y))
            chars += r["_n"]
    picked: dict[int, list[tuple[int, str]]] = {0: [], 1: []}
    if chosen:
        # at most TRAIN_ROWS rows of each class
        wanted = docs.sparkSession.createDataFrame(chosen, f"_want {docs.schema[key].dataType.simpleString()}, _wanted long, _y int")
        found = rows.join(F.broadcast(wanted), (F.col("_id") == F.col("_want")) & (F.col("_hash") == F.col("_wanted"))).groupBy("_y", "_hash").agg(F.first("_text").alias("_text"))
        for r in found.collect():
            picked[r["_y"]].append((r["_hash"], r["_text"]))
    return fit(*([t for _, t in sorted(picked[y])] for y in (1, 0)), docs.sparkSession)


def score(docs: DataFrame, model, text: str = "text", out: str = "score", evidence: str = "evidence") -> DataFrame:
    """``docs`` with the score (0 to 1) and the summed evidence it comes from; columns of those names are replaced."""
    kept = docs.drop(out, evidence)
    ordinary, toxic, weights, by_level = model

    def run(batches):
        meter, each = once(Meter, ordinary, toxic), np.array(weights)
        for b in batches:
            counts = np.array([meter.gains(t) for t in cells(b, text)]).reshape(-1, MOST + 1)
            sums = (looks(counts) @ each).tolist()
            yield with_columns(b, **{out: pa.array([by_level[level(e)] for e in sums], pa.float64()), evidence: pa.array(sums, pa.float64())})
    return map_batches(kept, run, schema_of(kept) + f"`{out}` double, `{evidence}` double")
