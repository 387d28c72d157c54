"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Every whole text becomes a row of about twenty statistics (lengths, shares of kinds of characters, repeats, compressed size).
They are brought to mean 0 and deviation 1 (of the training rows), cut at ``CUT`` deviations, and turned into ``FEATURES`` cosines of
random projections, whose inner products approximate a Gaussian kernel. Each partition of the labelled rows sums its own
part of the normal equations, for each of ``FOLDS`` folds apart; rows of these matrices are summed by row number in two steps, so no
task meets more than a bounded number of partitions and the driver gets matrices of ``FEATURES`` squared, whatever the input. Ridge
weights come from all folds, and for the calibration from all but one: the scores of each fold under the weights of the others
are counted in ``BINS`` bins, and neighbours that fall are pooled (isotonic regression); between pools the score is drawn straight.

All labelled rows are learnt from. Rows fall into folds by their statistics, so copies share one. Only the label and the text are looked
at. Null texts count as empty; an empty text has statistics like any other. Several labels of an id: the largest counts. Repeated
rows and ids are scored each by its text; null ids are scored and never learnt from. With labels of one class only, all scores are
that class (0 or 1), without any 0.5. Long texts are read whole. Empty tables give empty results; ``score`` keeps further columns
and replaces one that has the name of its result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.common import cells, map_batches, schema_of, stored, with_columns

#: Cosines, penalty for each labelled row, width of the kernel in deviations, most deviations of a statistic.
FEATURES, PENALTY, KERNEL, CUT = 320, 1e-4, 6.0, 5.0
FOLDS, BINS, SALTS = 3, 4096, 32
STATISTICS = ["words", "word_length", "word_deviation", "upper", "digits", "stops", "bangs", "symbols", "beyond_ascii", "distinct", "again", "most_frequent",
              "wordless", "odd_ends", "capitals", "same_lines", "line_words", "sentence_words", "packed", "white"]
WHITE, DIGITS, STOPS, BANGS = b" \t\n\v\f\r", b"0123456789", b".,;:", b"!?"
UPPER, SYMBOLS = bytes(range(65, 91)), b"#*$%&|<>@^~_=+\\/{}[]\""
HIGH, LETTERS = bytes(range(128, 256)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
ODD_ENDS = frozenset(SYMBOLS)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``."""
    raw = (text or "").encode("utf-8", "replace")
    size, words = max(len(raw), 1), raw.split()
    n = max(len(words), 1)

    def share(kind: bytes) -> float:
        return (len(raw) - len(raw.translate(None, kind))) / size
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    sentences = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    letterless = capitals = odd = 0
    for w, c in counts.items():
        letterless += c * (not w.translate(None, LETTERS) != w)
        capitals += c * (65 <= w[0] <= 90)
        odd += c * (w[-1] in ODD_ENDS)
    return [np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), share(UPPER), share(DIGITS), share(STOPS), share(BANGS), share(SYMBOLS), share(HIGH),
            len(counts) / n ** 0.8, sum(a == b for a, b in zip(words, words[1:])) / n, max(counts.values(), default=0) / n,
            letterless / n, odd / n, capitals / n, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1)),
            np.log1p(len(words) / max(sentences, 1)), len(zlib.compress(raw, 1)) / size, share(WHITE)]


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and ``stats`` of every row."""
    def run(batches):
        for b in batches:
            found = np.array([statistics(t) for t in cells(b, "_text")], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("_key"), as_lists(found)], ["_key", "stats"])
    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")), run, f"_key {kind}, stats array<double>")


def as_lists(x: np.ndarray) -> pa.Array:
    """A matrix as an Arrow column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)[:len(x) + 1]), pa.array(x.ravel()))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, width)


@dataclass(frozen=True)
class Projection:
    """Statistics to features; the last feature is 1."""

    mean: np.ndarray
    deviation: np.ndarray
    features: int = FEATURES
    kernel: float = KERNEL

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(20)
        directions = rng.normal(size=(len(self.mean), self.features)) / self.kernel
        phase = rng.uniform(0, 2 * np.pi, self.features)
        x = np.clip((stats - self.mean) / self.deviation, -CUT, CUT)
        return np.hstack([np.cos(x @ directions + phase) * np.sqrt(2 / self.features), np.ones((len(x), 1))])


@dataclass(frozen=True)
class Classifier:
    """What ``score`` needs; ``places`` and ``shares`` are the knots of the calibration."""

    project: Projection | None
    weights: np.ndarray
    places: np.ndarray
    shares: np.ndarray

    def probability(self, stats: np.ndarray) -> np.ndarray:
        if self.project is None:
            return np.full(len(stats), self.shares[0])
        return np.clip(np.interp(self.project(stats) @ self.weights, self.places, self.shares), 0, 1)


def normal_equations(rows: DataFrame, project: Projection) -> dict[int, np.ndarray]:
    """By fold the matrix of features' products and, in its last column, of products with the label, summed over all rows. ``rows``
    has fold, stats and y."""
    width = project.features + 1

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            z, fold = project(as_matrix(b.column("stats"), len(project.mean))), b.column("fold").to_numpy()
            y = b.column("y").to_numpy().astype(np.float64)
            for f in np.unique(fold):
                mine = fold == f
                sums[int(f)] = sums.get(int(f), 0.0) + z[mine].T @ np.hstack([z[mine], y[mine, None]])
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, f, np.int32)), pa.array(np.arange(width, dtype=np.int32)), as_lists(total)], ["fold", "row", "sums"])

    def added(keys, group):
        total = as_matrix(group.column("sums"), width + 1).sum(axis=0)
        return pa.table({"fold": pa.array([keys[0].as_py()], pa.int32()), "row": pa.array([keys[1].as_py()], pa.int32()), "sums": as_lists(total[None])})
    schema = "fold int, row int, sums array<double>"
    parts = map_batches(rows.select("fold", "stats", "y"), part, schema)
    salted = parts.withColumn("salt", F.spark_partition_id() % SALTS)
    some = salted.groupBy("fold", "row", "salt").applyInArrow(added, schema)
    out: dict[int, np.ndarray] = {}
    for r in some.groupBy("fold", "row").applyInArrow(added, schema).collect():
        out.setdefault(r["fold"], np.zeros((width, width + 1)))[r["row"]] = r["sums"]
    return out


def ridge(equations: list[np.ndarray], penalty: float = PENALTY) -> np.ndarray:
    """Weights from summed normal equations; the constant carries no penalty."""
    total = np.sum(equations, axis=0)
    rows = total[-1, -2]
    keep = np.full(len(total), penalty * rows)
    keep[-1] = 1e-9
    return np.linalg.solve(total[:, :-1] + np.diag(keep), total[:, -1])


def isotonic(place: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to the shares ``ones / n`` at sorted places: mean place and share of each pool."""
    pools: list[list[float]] = []
    for x, k, y in zip(place.tolist(), n.tolist(), ones.tolist()):
        pools.append([k * x, k, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", learn: Column | None = None) -> Classifier:
    """Fit on the labelled rows of ``stats`` (_key, stats) that fulfil ``learn``, a condition on _key."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("double").alias("y"))
    rows = (stats.where(learn) if learn is not None else stats).join(marked, F.col("_key") == F.col("_id"))
    rows = stored(rows.select("stats", "y", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled-stats")
    columns = [F.col("stats")[i] for i in range(len(STATISTICS))]
    known = rows.agg(F.count("*"), F.sum("y"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    n, ones = known[0], known[1] or 0.0
    if not 0 < ones < n:
        return Classifier(None, np.zeros(0), np.zeros(1), np.array([ones / n if n else 0.5]))
    mean, deviation = np.split(np.array(known[2:], np.float64), 2)
    project = Projection(mean, np.where(deviation > 1e-9, deviation, 1.0))
    by_fold = normal_equations(rows, project)
    others = {f: ridge([e for g, e in by_fold.items() if g != f] or list(by_fold.values())) for f in by_fold}

    def binned(batches):
        for b in batches:
            z, fold = project(as_matrix(b.column("stats"), len(mean))), b.column("fold").to_numpy()
            value = np.einsum("ij,ij->i", z, np.array([others[f] for f in fold.tolist()]).reshape(z.shape))
            yield pa.RecordBatch.from_arrays([pa.array((np.clip((value + 0.5) / 2, 0, 1) * BINS).astype(np.int32)), pa.array(value), b.column("y")], ["bin", "value", "y"])
    bins = map_batches(rows.select("fold", "stats", "y"), binned, "bin int, value double, y double").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("y").alias("ones"), F.avg("value").alias("place")).orderBy("bin").collect()
    places, shares = isotonic(*(np.array([r[c] for r in bins], np.float64) for c in ("place", "n", "ones")))
    return Classifier(project, ridge(list(by_fold.values())), places, shares)


def score(stats: DataFrame, model: Classifier, out: str = "score") -> DataFrame:
    """``stats`` (with its column stats) and the probability of label 1."""
    kept = stats.drop(out)

    def run(batches):
        for b in batches:
            yield with_columns(b, **{out: pa.array(model.probability(as_matrix(b.column("stats"), len(STATISTICS))), pa.float64())})
    return map_batches(kept, run, schema_of(kept) + f"`{out}` double")


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None) -> DataFrame:
    """key and score of every row of ``docs``; ``learn`` is a condition on _key. Texts are read once, their statistics are written."""
    stats = stored(described(docs, key, text), "stats")
    return score(stats, train(stats, labels, key, label, learn)).select(F.col("_key").alias(key), "score")
