"""SentencePiece encoding and decoding, with giant documents cut into chunks.

The library's merge order leaves exactly one segmentation of a text: the only sequence of pieces
in which every two neighbours, joined and merged anew, come back as the same two pieces. So the
segmentation is the best path of a max-plus system whose weights are 0 for such neighbours and
minus infinity for all others. A state at a chunk's border is the piece that reaches or crosses
it; a chunk's transfer matrix says which states at its end follow from which at its start. It
needs no text but the chunk's and as many characters beside it as the longest piece has.

Matrices of neighbouring chunks are multiplied in a tree of ``FAN`` branches (the product is associative);
states go down the tree again, which fixes them at every border; then each chunk is traced back on its own. Documents of one chunk have
both border states given and are encoded at once. Models whose normaliser changes characters
other than spaces are refused.

Defined cases: a null text is empty and has no ids; texts of any length are encoded whole, also
without a single space; repeated rows are encoded one by one; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

CHUNK = 16_384
#: Matrices that one group multiplies, and chunks whose matrices make up a task.
FAN = 64
TASK_CHUNKS = 512
SPACE = "▁"
#: State before the first and after the last character of a document.
EDGE = -1

ENCODED = "doc_id long, n_chars long, n_tokens long, ids binary, decoded string"

_pairs_kept = 2_000_000


class Pieces:
    """A model's pieces, its merge rule and the library's own encoder."""

    _open: dict[int, Pieces] = {}

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.vocab_size()
        self.names = [self.library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.id_of = {self.names[i]: i for i in plain}
        self.rank = {self.names[i]: self.library.get_score(i) for i in plain}
        self.longest = max(map(len, self.id_of), default=1)
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else b"" if self.library.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        self.byte_id = {int(p[3:-1], 16): i for i, p in enumerate(self.names) if self.library.is_byte(i)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        if self.library.normalize("a  B́ﬁ\n") != f"{SPACE}a{SPACE}{SPACE}B́ﬁ\n":
            raise ValueError("the model's normaliser changes characters other than spaces")
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece of the model spans words")

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        key = zlib.crc32(model)
        if key not in cls._open:
            cls._open[key] = cls(model)
        return cls._open[key]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def whole(self, piece: str) -> bool:
        if piece not in self.alone:
            self.alone[piece] = self.merged(piece) == [piece]
        return self.alone[piece]

    def neighbours(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > _pairs_kept:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that can stand at a place of a text; a character outside the vocabulary stands alone."""
        found = [text[at : at + 1]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            piece = text[at : at + n]
            if piece in self.id_of and self.whole(piece):
                found.append(piece)
        return found

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.id_of:
                out.append(self.id_of[p])
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in p.encode())
            else:
                out.append(self.library.unk_id())
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids of a whole document."""
        text = b"".join(map(self.bytes_of.__getitem__, ids))
        return (text[1:] if text.startswith(b" ") else text).decode(errors="replace")


def forward(model: Pieces, text: str, entries: list[tuple[int, str]], stop: int) -> tuple[dict, dict]:
    """Paths through ``text`` from some pieces, given as (their start, piece); ('', at 0) is the edge.

    Returns the pieces that start before ``stop`` and reach or cross it as
    {(start, piece): bits of the entries they follow from} and the predecessors of all pieces.
    """
    ending: dict[int, list[tuple[int, str, int]]] = {}
    reached: dict[tuple[int, str], int] = {}
    before: dict[tuple[int, str], list[tuple[int, str]]] = {}

    def put(start: int, piece: str, bits: int) -> None:
        end = start + len(piece)
        if end >= stop and (start < stop or not piece):
            reached[start, piece] = reached.get((start, piece), 0) | bits
        if end < stop:
            ending.setdefault(end, []).append((start, piece, bits))

    for i, (start, piece) in enumerate(entries):
        put(start, piece, 1 << i)
    for at in range(min(ending, default=stop), stop):
        here = ending.pop(at, None)
        if not here:
            continue
        merged: dict[tuple[int, str], int] = {}
        for start, piece, bits in here:
            merged[start, piece] = merged.get((start, piece), 0) | bits
        for piece in model.starting(text, at):
            bits, origin = 0, []
            for (start, left), own in merged.items():
                if not left or model.neighbours(left, piece):
                    bits |= own
                    origin.append((start, left))
            if bits:
                before.setdefault((at, piece), []).extend(origin)
                put(at, piece, bits)
    return reached, before


def trace(before: dict, last: tuple[int, str], first: tuple[int, str]) -> list[tuple[int, str]]:
    """The one path of pieces from ``first`` (left out) to ``last``."""
    stack = [(last, [last])]
    while stack:
        node, path = stack.pop()
        origins = before.get(node, [])
        if first in origins:
            return path[::-1]
        stack.extend((o, [*path, o]) for o in origins)
    raise ValueError("no path between two border states")


class Chunk:
    """A chunk with the characters beside it; places count from the first of those."""

    def __init__(self, model: Pieces, left: str, core: str, right: str, first: bool, last: bool):
        self.model, self.text = model, left + core + right
        self.begin, self.stop = len(left), len(left) + len(core)
        self.first, self.last = first, last
        # Word starts between which nothing depends on the borders; none in a chunk without words.
        self.a = self._word_start(range(self.begin + 1, self.stop))
        self.b = self._word_start(range(self.stop - 1, self.begin, -1))
        if self.a == self.b:
            self.a = self.b = None

    def _word_start(self, places: range) -> int | None:
        return next((at for at in places if self.text[at] == SPACE and self.text[at - 1] != SPACE), None)

    def entries(self) -> list[tuple[int, str]]:
        if self.first:
            return [(self.begin, "")]
        for at in range(self.begin - 1, 0, -1):
            # A word start before the border leaves only the pieces that its prefix can reach.
            if self.text[at] == SPACE and self.text[at - 1] != SPACE:
                return list(forward(self.model, self.text, [(at, "")], self.begin)[0])
        return [(s, p) for s in range(max(0, self.begin - self.model.longest), self.begin) for p in self.model.starting(self.text, s) if s + len(p) >= self.begin]

    def _exits(self, reached: dict) -> dict:
        return {k: v for k, v in reached.items() if not self.last or k[0] + len(k[1]) == self.stop}

    def transfer(self) -> list[tuple[tuple[int, str], tuple[int, str]]]:
        """Pairs of border states with weight 0; all others weigh minus infinity."""
        entries = self.entries()
        if self.a is None:
            reached = self._exits(forward(self.model, self.text, entries, self.stop)[0])
            return [(e, x) for x, bits in reached.items() for i, e in enumerate(entries) if bits >> i & 1]
        head = forward(self.model, self.text, entries, self.a)[0]
        fits = 0
        for (start, piece), bits in head.items():
            fits |= bits if start + len(piece) == self.a else 0
        tail = self._exits(forward(self.model, self.text, [(self.b, "")], self.stop)[0])
        return [(e, x) for i, e in enumerate(entries) if fits >> i & 1 for x in tail]

    def pieces_ids(self, entry: tuple[int, str], exit_: tuple[int, str]) -> list[int]:
        """Ids of the pieces that start within the chunk."""
        if self.a is None:
            return self.model.ids([p for s, p in trace(forward(self.model, self.text, [entry], self.stop)[1], exit_, entry) if s >= self.begin]) if exit_ != entry else []
        out: list[int] = []
        if entry[0] + len(entry[1]) < self.a:
            reached, before = forward(self.model, self.text, [entry], self.a)
            last = next(k for k in reached if k[0] + len(k[1]) == self.a)
            out += self.model.ids([p for _, p in trace(before, last, entry)])
        out += self.model.library.encode(self.text[self.a + 1 : self.b].replace(SPACE, " "))
        edge = (self.b, "")
        return out + self.model.ids([p for _, p in trace(forward(self.model, self.text, [edge], self.stop)[1], exit_, edge)])


def _chunks(text: str, size: int, beside: int) -> Iterator[tuple[int, int, str, str, str]]:
    """(number, how many, left, core, right) of the marked text."""
    marked = SPACE + text.replace(" ", SPACE)
    n = -(-len(marked) // size)
    for k in range(n):
        a, b = k * size, min((k + 1) * size, len(marked))
        yield k, n, marked[max(0, a - beside) : a], marked[a:b], marked[b : b + beside]


def product(first: list[tuple[str, str]], second: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs of border states that two neighbouring stretches connect; associative."""
    after: dict[str, list[str]] = {}
    for a, b in second:
        after.setdefault(a, []).append(b)
    return list(dict.fromkeys((a, c) for a, b in first for c in after.get(b, ())))


def border_states(matrices: list[list[tuple[str, str]]], entry: str | None = None, exit_: str | None = None) -> list[tuple[str, str]]:
    """(entry, exit) of every chunk on the one path through the product of all matrices, between given borders if any."""
    reach = {entry if entry is not None else matrices[0][0][0]} if matrices[0] else set()
    seen = []
    for m in matrices:
        seen.append([(a, b) for a, b in m if a in reach])
        reach = {b for _, b in seen[-1]}
    out: list[tuple[str, str]] = []
    for m in reversed(seen):
        goal = out[-1][0] if out else exit_
        out.append(next((a, b) for a, b in m if goal is None or b == goal))
    return out[::-1]


def _matrices(frame: pd.DataFrame) -> list[list[tuple[str, str]]]:
    return [list(zip(a, b, strict=True)) for a, b in zip(frame["starts"], frame["ends"], strict=True)]


def _folded(frame: pd.DataFrame) -> pd.DataFrame:
    """The product of up to ``FAN`` neighbouring matrices."""
    pairs = functools.reduce(product, _matrices(frame.sort_values("k")))
    return pd.DataFrame({"row": frame["row"].iloc[:1], "k": frame["up"].iloc[:1], "starts": [[a for a, _ in pairs]], "ends": [[b for _, b in pairs]]})


def _borders(frame: pd.DataFrame) -> pd.DataFrame:
    """Border states of up to ``FAN`` neighbours, between those of their stretch where it is a part of a document."""
    frame = frame.sort_values("k")
    outer = (frame["entry"].iloc[0], frame["exit"].iloc[0]) if "entry" in frame else ()
    steps = border_states(_matrices(frame), *outer)
    return pd.DataFrame({"row": frame["row"], "k": frame["k"], "entry": [a for a, _ in steps], "exit": [b for _, b in steps]})


def known_borders(matrices: DataFrame, longest: int, chunks: int, fan: int = FAN) -> DataFrame:
    """(row, k, entry, exit) of every chunk: products of ``fan`` neighbours up a tree, states down again.

    ``matrices`` holds (row, k, starts, ends), at most ``longest`` of a row. No group holds more than ``fan``
    matrices; the number of tasks follows the ``chunks``, as the few bytes of the matrices say nothing of their work.
    """
    def stretches(level: DataFrame, n: int) -> DataFrame:
        return level.withColumn("up", F.floor(F.col("k") / fan).cast("int")).repartition(1 + n // TASK_CHUNKS, "row", "up")

    levels = [stretches(matrices, chunks)]
    while longest > fan:
        above = levels[-1].groupBy("row", "up").applyInPandas(_folded, "row long, k int, starts array<string>, ends array<string>")
        longest, chunks = -(-longest // fan), -(-chunks // fan)
        levels.append(stretches(above, chunks))
    states = "row long, k int, entry string, exit string"
    known = levels[-1].groupBy("row", "up").applyInPandas(_borders, states)
    for level in reversed(levels[:-1]):
        outer = known.withColumnRenamed("k", "up")
        known = level.join(outer, ["row", "up"]).groupBy("row", "up").applyInPandas(_borders, states)
    return known


def _name(state: tuple[int, str], origin: int) -> str:
    """A border state as text: the piece and how far before the border it starts."""
    return f"{origin - state[0]} {state[1]}"


def _state(name: str, origin: int) -> tuple[int, str]:
    back, piece = name.split(" ", 1)
    return origin - int(back), piece


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per document: ids as little-endian 32-bit integers in one binary value, and the text decoded from them.

    The model file (under a MB, whatever the data) is read on the driver and shipped to the tasks.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    own = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text).alias("text"))
    size = F.length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(shipped.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = part.column(1).to_pylist()
                ids = model.library.encode(texts, num_threads=1)
                out = [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(len, ids), pa.int64())]
                out += [pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary()), pa.array(map(model.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_chars", "n_tokens", "ids", "decoded"])

    # A document shorter than a chunk has the edge on both sides.
    small = own.where(size < chunk).select("doc_id", "text").mapInArrow(short, ENCODED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Pieces.of(shipped.value).longest
        for batch in batches:
            for row, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [(row, key, *c) for c in _chunks(value, chunk, beside)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), CUT_TYPES, strict=True)], names=CUT.names)

    CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("left", pa.string()), ("core", pa.string()), ("right", pa.string())])
    CUT_TYPES = CUT.types
    parts = own.where(size >= chunk).mapInArrow(cut, "row long, doc_id long, k int, n int, left string, core string, right string")
    # Chunks of one giant document go to different tasks.
    parts = parts.repartition("row", "k")

    def open_chunk(model: Pieces, r: dict) -> Chunk:
        return Chunk(model, r["left"], r["core"], r["right"], r["k"] == 0, r["k"] == r["n"] - 1)

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(shipped.value)
        for batch in batches:
            rows, ks, starts, ends = [], [], [], []
            for r in batch.to_pylist():
                c = open_chunk(model, r)
                pairs = c.transfer()
                rows.append(r["row"])
                ks.append(r["k"])
                starts.append([_name(a, c.begin) for a, _ in pairs])
                ends.append([_name(b, c.stop) for _, b in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ks, pa.int32()), pa.array(starts, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.string()))], names=["row", "k", "starts", "ends"])

    matrices = parts.mapInArrow(transfers, "row long, k int, starts array<string>, ends array<string>")

    n_chunks = F.ceil((size + 1) / chunk)
    most, total = docs.select(whole_text(docs, text).alias("text")).where(size >= chunk).agg(F.max(n_chunks), F.sum(n_chunks)).head()
    known = known_borders(matrices, most or 0, total or 0, fan)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(shipped.value)
        for batch in batches:
            ids = []
            for r in batch.to_pylist():
                c = open_chunk(model, r)
                ids.append(np.array(c.pieces_ids(_state(r["entry"], c.begin), _state(r["exit"], c.stop)), "<u4").tobytes())
            chars = [len(x.as_py()) for x in batch.column("core")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("k"), pa.array(chars, pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "k", "chars", "ids"])

    pieces = parts.join(known, ["row", "k"]).mapInArrow(traced, "row long, doc_id long, k int, chars long, ids binary")

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        model = Pieces.of(shipped.value)
        frame = frame.sort_values("k")
        ids = b"".join(frame["ids"])
        values = np.frombuffer(ids, "<u4").tolist()
        out = pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1].astype("Int64"), "n_chars": [int(frame["chars"].sum()) - 1]})
        return out.assign(n_tokens=len(values), ids=[ids], decoded=[model.decode(values)])

    # A group is one document, which was one row of the input.
    large = pieces.groupBy("row").applyInPandas(joined, ENCODED)
    return small.unionByName(large)
