"""SentencePiece encoding and decoding by a merge-type prefix table.

A merge-type (BPE) encoding has one property that makes a linear encoder possible: for
every prefix of a text there is exactly one piece with which the encoding of that prefix
ends. The encoder walks the text once with an automaton of all pieces and keeps that last
piece for each prefix. A piece found at a position fits if it encodes to itself and if the
pair of it and the last piece of the prefix before it encodes to just these two (the pair
test, remembered per pair). The ids are then read backwards from the last prefix.

Characters that no piece has are written as bytes; nothing merges across them, so they cut
the text into independent parts. No piece goes on behind a space into the next word either
(checked when the model is loaded), so words are encoded one by one and remembered.

Null text counts as empty. Rows are independent: repeated rows give repeated results, an
empty table gives an empty one. Very long texts are encoded whole, word by word. Extra columns are kept by ``encode`` and ``decode``, which replace
one with the name of their result; ``digests`` looks at no column but the key and the text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.common import cells, map_batches, once, schema_of, with_columns

#: How SentencePiece writes a space, and what it writes for the unknown id.
SPACE, UNKNOWN = "▁", " ⁇ "
#: A score below all others: a whole piece grows no further.
NEVER = float("-inf")
#: Words and pairs remembered by a worker (about 200 and 100 bytes each), in two halves: when the newer is full the older goes, and
#: what is met again moves to the newer.
WORDS_KEPT, PAIRS_KEPT = 300_000, 600_000


class PieceModel:
    """Encoder and decoder of one merge-type model file without normalisation rules."""

    def __init__(self, file: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.size, self.ids = n, {model.id_to_piece(i): i for i in plain}
        self.piece_of = {i: p for p, i in self.ids.items()}
        self.length_of = {i: len(p) for p, i in self.ids.items()}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.shown = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        #: What an id decodes to whatever stands beside it: all but the bytes of longer characters.
        self.alone = [self.shown.get(i, UNKNOWN if i == self.unk else "") for i in range(n)]
        for i, b in self.byte_of.items():
            self.alone[i] = chr(b) if b < 128 else None
        if len(self.byte_ids) < 256 or 0 in self.piece_of:
            raise ValueError("the model has no byte fallback, or an ordinary piece as id 0")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of the model goes over the start of a word")
        self.letters = {c for p in self.ids for c in p}
        if any(c not in self.ids for c in self.letters):
            raise ValueError("a piece of the model has a character that is no piece")
        if model.encode("a  b") != model.encode("a ") + model.encode(" b")[1:] and model.encode("A ", out_type=str) == model.encode("A ", out_type=str):
            raise ValueError("the model normalises its input")
        self.pairs, self.old_pairs = {}, {}
        self.words, self.old_words = {}, {}
        #: Pieces whose score no other piece has, and whose parts were joined before them: for these the pair test is short.
        shared = Counter(self.score.values())
        self.left_edge: dict[str, list[tuple[str, float]]] = {}
        self.right_edge: dict[str, list[tuple[str, float]]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in sorted(self.ids, key=len):
            parts, halves = self.merged(p)
            if parts != [p]:
                continue
            self.automaton.add_word(p, (self.ids[p], len(p)))
            if halves is None:
                self.left_edge[p] = self.right_edge[p] = [(p, NEVER)]
            elif shared[self.score[p]] == 1 and all(h in self.left_edge and (len(h) == 1 or self.score[h] > self.score[p]) for h in halves):
                self.left_edge[p], self.right_edge[p] = ([(p, NEVER), (h, self.score[p]), *edge[h][1:]]
                                                         for h, edge in zip(halves, (self.left_edge, self.right_edge)))
        self.automaton.make_automaton()
        #: A line break that is no piece is a cut of its own, so that the words around it are remembered alone.
        cut = "" if "\n" in self.letters else "\n"
        self.split = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|{cut}" if cut else "")).findall

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The definition: join the best pair, the leftmost of equals, until none is a piece. For short strings.
        Also gives the two that were joined last."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            last = parts[best], parts[best + 1]
            parts[best:best + 2] = ["".join(last)]
        return parts, last

    def stays_apart(self, left: str, right: str) -> bool:
        """Each piece grows at the boundary from a character to itself. The pair breaks if at some time what stands on
        both sides of the boundary joins to a piece that is better than what either side is to grow into next."""
        if left not in self.right_edge or right not in self.left_edge:
            return self.merged(left + right)[0] == [left, right]
        score = self.score.get
        for a, grows_a in self.right_edge[left]:
            for b, grows_b in self.left_edge[right]:
                joined = score(a + b)
                if joined is not None and joined > grows_a and joined >= grows_b:
                    return False
        return True

    def part(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces: prefix table forwards, ids backwards."""
        last, pairs, base = [0] * (len(text) + 1), self.pairs, self.size
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            if end == length:
                last[end] = piece
                continue
            pair = last[end - length] * base + piece
            fits = pairs.get(pair)
            if fits is None:
                fits = self.old_pairs.get(pair)
                if fits is None:
                    fits = self.stays_apart(self.piece_of[last[end - length]], self.piece_of[piece])
                if len(pairs) >= PAIRS_KEPT // 2:
                    self.old_pairs, self.pairs = pairs, {}
                    pairs = self.pairs
                pairs[pair] = fits
            if fits:
                last[end] = piece
        ids, at, length = [], len(text), self.length_of
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def word(self, text: str) -> list[int]:
        """Ids of any text that starts at a cut; characters without a piece become bytes."""
        if self.letters.issuperset(text):
            return self.part(text)
        ids, start = [], 0
        for i, c in enumerate(text):
            if c not in self.letters:
                if start < i:
                    ids += self.part(text[start:i])
                ids += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = i + 1
        return ids + self.part(text[start:]) if start < len(text) else ids

    def kept(self, word: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers."""
        found = self.words.get(word)
        if found is None:
            found = self.old_words.get(word)
            if found is None:
                found = pack(self.word(word))
            if len(word) <= 256:
                if len(self.words) >= WORDS_KEPT // 2:
                    self.old_words, self.words = self.words, {}
                self.words[word] = found
        return found

    def cut(self, text: str) -> list[str]:
        """The words of a text, the space before the text included."""
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> list[int]:
        ids = [self.bos] if bos else []
        for w in self.cut(text):
            ids += self.word(w)
        return ids + [self.eos] if eos else ids

    def shown_text(self, ids: Sequence[int]) -> str:
        """Text of ids, the space at the start included."""
        try:
            return "".join(map(self.alone.__getitem__, ids))
        except TypeError:  # bytes that make a character together
            pass
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(whole_characters(bytes(raw)))
                raw.clear()
            if i is not None:
                out.append(UNKNOWN if i == self.unk else self.shown.get(i, ""))
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """What the library's ``decode(ids)`` gives: the one space before the text goes."""
        first = next((i for i in ids if i not in (self.bos, self.eos)), None)
        text = self.shown_text(ids)
        return text[1:] if first in self.shown and text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Of a text: number of ids, digest of the ids, digest of the text that these ids decode to."""
        packed = b"".join([pack([self.bos]), *map(self.kept, self.cut(text)), pack([self.eos])])
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8", "replace")).hexdigest()


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def whole_characters(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that is no part of a character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids", bos: bool = True, eos: bool = True) -> DataFrame:
    """``docs`` with a column ``out`` of ids (array of int). A column of that name is replaced."""
    def run(batches):
        m = once(PieceModel, model)
        for b in batches:
            ids = pa.array([m.encode(t or "", bos, eos) for t in cells(b, text)], pa.list_(pa.int32()))
            yield with_columns(b, **{out: ids})
    kept = docs.drop(out)
    return map_batches(kept, run, schema_of(kept) + f"`{out}` array<int>")


def decode(docs: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with a column ``out`` of decoded text; null ids give the empty text."""
    def run(batches):
        m = once(PieceModel, model)
        for b in batches:
            texts = pa.array([m.decode(x or []) for x in cells(b, ids)], pa.string())
            yield with_columns(b, **{out: texts})
    kept = docs.drop(out)
    return map_batches(kept, run, schema_of(kept) + f"`{out}` string")


def digests(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of ids, digests of the ids and of the text that they are decoded to; no id leaves its task."""
    def run(batches):
        m = once(PieceModel, model)
        for b in batches:
            found = [m.digest(t or "") for t in cells(b, text)]
            counts, of_ids, of_text = (pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays([b.column(key), counts, of_ids, of_text], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, F.col(text).cast("string").alias(text)), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> bytes:
    """The given model file; any other merge-type file can be passed instead. Its bytes go to the tasks, not its place."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()
