"""Token counts by section of a document.

A whole document is encoded once; a token is never made from a section alone, so the counts add up to
the document's. The tokens of a byte-level encoding write the text again byte by byte, so their lengths
give every token's span. Tokens and sections are both in order of place, and joined as intervals by one
search of the section bounds among the token bounds. A token that lies over a bound goes by rule:

* ``start``: to the section with its first byte;
* ``end``: to the section with its last byte;
* ``most``: to the section with most of its bytes, the earlier of equals;
* ``shares``: to each section by its share of the bytes (fractions).

Bytes between sections belong to no section; they are given as section -1 if a token falls there.
Sections must not overlap. Null and empty texts have no tokens: one row with the empty section 0.
Very long texts are encoded whole. Repeated rows give repeated results, an empty table an empty one; no other column is looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.common import cells, map_batches, once

RULES = ("start", "end", "most", "shares")


class Encoder:
    """A byte-level encoding from a rank file, with the length in bytes of every token."""

    def __init__(self, file: bytes, pattern: str):
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def bounds(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) in bytes of each token of a whole text."""
        ends = np.cumsum(self.size[self.encoding.encode_ordinary(text)])
        return np.r_[0, ends[:-1]] if len(ends) else ends, ends


def line_sections(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of the lines of a text, each with its line break."""
    ends = [i + 1 for i, c in enumerate(raw) if c == 10] if len(raw) < 64 else (np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1).tolist()
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    return list(zip([0, *ends[:-1]], ends))


def allotted(start: np.ndarray, end: np.ndarray, sections: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section, and those that fall between sections."""
    lows, highs = (np.array(x, np.int64) for x in zip(*sections))
    if rule in ("start", "end"):
        place = start if rule == "start" else end - 1
        at = np.searchsorted(lows, place, "right") - 1
        inside = (at >= 0) & (place < highs[np.maximum(at, 0)])
        return np.bincount(at[inside], minlength=len(sections)).astype(float), float((~inside).sum())
    # the sections that a token meets: from the first that ends behind its start to the last that starts before its end
    first, last = np.searchsorted(highs, start, "right"), np.searchsorted(lows, end, "left") - 1
    counts, rest = np.zeros(len(sections)), 0.0
    single = first == last
    inside = single & (start >= lows[np.minimum(first, len(lows) - 1)]) & (end <= highs[np.minimum(first, len(lows) - 1)])
    counts += np.bincount(first[inside], minlength=len(sections))
    for i in np.flatnonzero(~inside):
        a, b = start[i], end[i]
        meets = np.arange(first[i], last[i] + 1)
        bytes_in = np.minimum(b, highs[meets]) - np.maximum(a, lows[meets]) if len(meets) else np.zeros(0, np.int64)
        outside = (b - a) - bytes_in.sum()
        if rule == "shares":
            np.add.at(counts, meets, bytes_in / (b - a))
            rest += outside / (b - a)
        elif len(meets) and bytes_in.max() >= outside:
            counts[meets[int(bytes_in.argmax())]] += 1
        else:
            rest += 1
    return counts, rest


def section_tokens(docs: DataFrame, encoder: tuple[bytes, str], key: str = "doc_id", text: str = "text", rule: str = "most",
                   sections: Callable[[bytes], list[tuple[int, int]]] = line_sections) -> DataFrame:
    """One row per document and section: key, section (from 0), span_start and span_end (bytes), n_tokens (by the rule), and
    doc_tokens. ``sections`` gives byte spans of a text, in order; ``encoder`` is a rank file, as bytes, and its pattern."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        e = once(Encoder, *encoder)
        for b in batches:
            index, number, lows, highs, counts, totals = [], [], [], [], [], []

            def add(i, numbers, spans, found, total):
                index.append(np.full(len(found), i))
                number.append(np.asarray(numbers))
                lows.append([s[0] for s in spans])
                highs.append([s[1] for s in spans])
                counts.append(found)
                totals.append(np.full(len(found), total))
            for i, t in enumerate(cells(b, "_text")):
                spans = sections((t or "").encode("utf-8", "replace")) or [(0, 0)]
                start, end = e.bounds(t or "")
                found, rest = allotted(start, end, spans, rule)
                add(i, np.arange(len(spans)), spans, found, len(start))
                if rest > 0:
                    add(i, [-1], [(0, 0)], [rest], len(start))
            if index:
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(pa.array(np.concatenate(index))), pa.array(np.concatenate(number), pa.int64()), pa.array(np.concatenate(lows), pa.int64()),
                     pa.array(np.concatenate(highs), pa.int64()), pa.array(np.concatenate(counts), pa.float64()), pa.array(np.concatenate(totals), pa.int64())],
                    [key, "section", "span_start", "span_end", "n_tokens", "doc_tokens"])
    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, F.col(text).cast("string").alias("_text")), run,
                       f"`{key}` {kind}, section long, span_start long, span_end long, n_tokens double, doc_tokens long")


def default_encoder() -> tuple[bytes, str]:
    """The given rank file, whose bytes go to the tasks, and pattern; any other of the kind can be passed instead."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN
