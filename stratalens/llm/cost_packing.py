"""Cost-balanced packing of documents into training sequences.

Documents are tokenised and end with an end id. Attention over a piece of ``n`` ids costs about
``LINEAR * n + QUADRATIC * n * n``; pieces go, longest first, to the sequence of lowest cost so
far that still has room. A piece that fits nowhere is cut at the room of the cheapest sequence.
Each task packs the documents it reads in groups of about ``GROUP`` ids; the rest of a group that
does not fill a sequence becomes sequences whose sizes are powers of two, so nothing is padded.

Texts are encoded word by word through a table of words seen by the worker. That equals encoding
the whole text, because the vocabulary's pattern never joins characters over a space and a run of
letters ends at a punctuation mark; a text that spells a special token is encoded whole.

Defined cases: a null text is empty and becomes the end id alone; a document of any length is cut
into full sequences first; repeated rows are packed once each; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import whole_text

SEQUENCE = 2048
END_ID = 1
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
GROUP = 1 << 21
#: Words whose ids a worker keeps; beyond that it starts anew.
WORDS_KEPT = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_BLANKS = bytes(32 if i in b"\t\n\r" else i for i in range(256))
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,;:!?*%#$&|")] = True


class Encoder:
    """Whole texts to little-endian 32-bit ids by a word-level vocabulary that lowers A to Z."""

    _open: dict[int, Encoder] = {}

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(vocabulary)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        # Digits stand alone in this vocabulary, so one of them can part words encoded in one call.
        self.marks = {d: int(x[1]) for d in "0123456789" if len(x := self._ids(f"a {d} b")) == 3}
        # Where the vocabulary marks the last piece of a run of letters, words of letters need no mark.
        suffix = self.model.model.end_of_word_suffix
        self.last = np.zeros(self.model.get_vocab_size(), bool)
        if suffix:
            self.last[[i for piece, i in self.model.get_vocab().items() if piece.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {b"": b""}

    @classmethod
    def of(cls, vocabulary: bytes) -> Encoder:
        key = zlib.crc32(vocabulary)
        if key not in cls._open:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls._open[key] = cls(vocabulary)
        return cls._open[key]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[bytes]) -> None:
        for first in range(0, len(words), 4096):
            part = [w.decode() for w in words[first : first + 4096]]
            if self.last.any():
                letters = [w for w in part if w.isalpha()]
                part = [w for w in part if not w.isalpha()]
                ids = self._ids(" ".join(letters))
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(letters):
                    self._put(letters, ids, [0, *ends.tolist()][: len(letters)], ends.tolist())
                else:
                    part += letters
            joined = "".join(part)
            mark = min(self.marks, key=joined.count, default="")
            for word in [w for w in part if mark in w]:
                self.words[word.encode()] = self._ids(word).tobytes()
            part = [w for w in part if mark not in w]
            if part:
                ids = self._ids(f" {mark} ".join(part))
                ends = np.append(np.flatnonzero(ids == self.marks[mark]), len(ids)).tolist()
                self._put(part, ids, [0, *(e + 1 for e in ends[:-1])], ends)

    def _put(self, words: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw = ids.tobytes()
        self.words.update((w.encode(), raw[4 * a : 4 * b]) for w, a, b in zip(words, starts, ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        low = [t.encode().lower() for t in texts]
        whole = {i for i, t in enumerate(low) if b"\x00" in t or any(mark in t for mark in self.special)}
        # One buffer for all texts; a blank goes before every mark that follows a letter.
        data = np.frombuffer(b"\x00 ".join(b"" if i in whole else t.translate(_BLANKS) for i, t in enumerate(low)), np.uint8)
        at = np.flatnonzero(_LETTER[data[:-1]] & _POINT[data[1:]]) + 1
        split = [t.split(b" ") for t in np.insert(data, at, 32).tobytes().split(b"\x00 ")]
        seen = set().union(*split)
        new = list(seen.difference(self.words))
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words = {b"": b""}
            new = [w for w in seen if w]
        self._learn(new)
        # The words of these texts in a table of their own, small enough for the processor's cache.
        get = dict(zip(seen, map(self.words.__getitem__, seen), strict=True)).__getitem__
        return [self._ids(t).tobytes() if i in whole else b"".join(map(get, w)) for i, (t, w) in enumerate(zip(texts, split, strict=True))]


def capacities(total: int, size: int) -> list[int]:
    """Full sequences, then the powers of two that add up to the rest."""
    rest = total % size
    return [size] * (total // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of some lengths; every sequence is full."""
    room = np.array(capacities(sum(lengths), size), dtype=np.int64)
    cap = room.copy()
    cost = np.zeros(len(room))
    out, rest, opened = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // size):
            out.append((d, k * size, size, opened, 0))
            opened += 1
        if n % size:
            rest.append((n % size, d, n - n % size))
    room[:opened] = 0
    cost[:opened] = np.inf
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in rest:
        while n:
            held = np.where(room >= n, cost, np.inf)
            s = int(held.argmin())
            if held[s] == np.inf:  # nowhere whole: cut at the room of the cheapest
                s = int(np.where(room > 0, cost, np.inf).argmin())
            piece = min(n, int(room[s]))
            out.append((d, start, piece, s, int(cap[s] - room[s])))
            room[s] -= piece
            cost[s] += LINEAR * piece + QUADRATIC * piece * piece
            start += piece
            n -= piece
    return out


def pack(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents (see SCHEMA); ``vocabulary`` is the path of a tokenizers file.

    The file (a few MB, whatever the data) is read on the driver and shipped to the tasks.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    with open(vocabulary, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shipped.value)
        base, used = TaskContext.get().partitionId() << 33, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        keys: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal used
            rows = assign([len(x) // 4 for x in held], size)
            columns = list(zip(*rows, strict=True))
            crc = [zlib.crc32(memoryview(held[d])[4 * a : 4 * (a + n)]) for d, a, n, _, _ in rows]
            out = [[keys[d] for d in columns[0]], columns[1], columns[2], crc, [len(held[d]) // 4 for d in columns[0]], [base + used + s for s in columns[3]], columns[4]]
            used += max(columns[3]) + 1
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in SCHEMA.split(", ")])

        size_held = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first in range(0, len(ids), 256):
                for key, raw in zip(ids[first : first + 256], encoder.encode(texts.slice(first, 256).to_pylist()), strict=True):
                    keys.append(key)
                    held.append(raw + end)
                    size_held += len(raw) // 4 + 1
                if size_held >= GROUP:
                    yield close()
                    size_held = 0
        if held:
            yield close()

    return docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text).alias("text")).mapInArrow(packed, SCHEMA)
