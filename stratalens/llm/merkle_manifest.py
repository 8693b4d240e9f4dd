"""Merkle dataset manifest: a tree of digests over ordered rows, and an inclusion proof for every row.

Rows of a part are leaves in the order of their ids; runs of two nodes become their parent until one
node, the part's subroot, remains. Subroots, ordered by part, are the leaves of the tree that gives
the root.

Trees are evaluated by time-forward processing. A node's label is (last leaf below it, level), so
children come before parents. Going up, a priority queue ordered by label delivers digests
of children to their parent, which is due once the sweep has passed its last leaf. Going down, the reversed sweep
delivers to every child its proof suffix: the sibling on its level, then the suffix of its parent.
What the queue would hold on disk is Spark's sorted shuffle: a task sweeps blocks of ``2 ** LEVELS``
consecutive nodes in order and sends one digest to the block above, or gets one suffix from it, so a
part of any size is spread over many tasks and takes one round per ``LEVELS`` levels each way.

Defined cases: null values and texts are marked as such, apart from empty ones; null ids come first;
rows with equal ids are ordered by their digests, and equal rows are leaves of their own;
a null part is a part of its own and comes first; an only leaf is its tree's root; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Levels of a tree that one task sweeps at once.
LEVELS = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Steps of a proof: a sibling to the left or right, or none beside the last node of a level.
LEFT, RIGHT, ALONE = "L", "R", "-"

NODE = "part string, idx long, n long, digest binary"
SUFFIX = "part string, idx long, proof array<string>, subroot binary, root binary"


def encoded(values: Sequence[Column]) -> Column:
    """What a leaf is the digest of: ``-`` for a null, else the bytes of a value, ``:`` and the value."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.concat(*[one(v.cast("string")) for v in values])


def digest_of(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(encoded(values).cast("binary"), 256))


def _joined(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _height(n: int, most: int) -> int:
    return min(max(n - 1, 0).bit_length(), most)


class Block:
    """Some consecutive nodes of one level, and the levels above them."""

    def __init__(self, part: str | None, block: int, n: int, most: int):
        self.part, self.block, self.n = part, block, n
        self.height = _height(n, most)
        self.size = min(n - (block << most), 1 << most)
        self.levels: list[list[bytes]] = [[] for _ in range(self.height + 1)]
        self._due: list[tuple[int, int, int, bytes]] = []

    def last(self, level: int, i: int) -> int:
        """The last leaf below a node: its time, as far as its level does not decide."""
        return min((i + 1) << level, self.size) - 1

    def add(self, digest: bytes) -> None:
        """The next leaf; parents whose last leaf it is follow at once."""
        at = len(self.levels[0])
        self._done(0, at, digest)
        while self._due and self._due[0][0] <= at:
            last, level, _, first = heapq.heappop(self._due)
            children = [first]
            while self._due and self._due[0][:2] == (last, level):
                children.append(heapq.heappop(self._due)[3])
            self._done(level, last >> level, _joined(children))

    def _done(self, level: int, i: int, digest: bytes) -> None:
        self.levels[level].append(digest)
        if level < self.height:
            heapq.heappush(self._due, (self.last(level + 1, i >> 1), level + 1, i, digest))

    @property
    def root(self) -> bytes:
        return self.levels[self.height][0]

    def suffixes(self, above: list[str]) -> list[list[str]]:
        """The proof of every leaf, given that of the block's root: the sweep in reverse."""
        out: list[list[str]] = [[]] * self.size
        due = [(-self.last(self.height, 0), -self.height, 0, above)]
        while due:
            _, level, i, proof = heapq.heappop(due)
            level = -level
            if not level:
                out[i] = proof
                continue
            below = self.levels[level - 1]
            children = [c for c in (2 * i, 2 * i + 1) if c < len(below)]
            for c in children:
                step = ALONE if len(children) == 1 else (LEFT if c & 1 else RIGHT) + below[c ^ 1].hex()
                heapq.heappush(due, (-self.last(level - 1, c), 1 - level, c, [step, *proof]))
        return out


def _ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``idx``, the place within the part, and ``n``, the part's size; no part is in one task."""
    placed = nodes.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)))
    # A row for every part of every task: as many as tasks and parts together.
    spans = placed.groupBy("part", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    of = Window.partitionBy("part")
    before = F.coalesce(F.sum("own").over(of.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("part").alias("p"), F.col("task").alias("t"), (before - F.col("first")).alias("shift"), F.sum("own").over(of).alias("n"))
    both = placed.join(spans, F.col("part").eqNullSafe(F.col("p")) & (F.col("task") == F.col("t")))
    return both.select("*", (F.col("at") + F.col("shift")).alias("idx")).drop("p", "t", "at", "task", "shift")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _swept(nodes: DataFrame, levels: int, *first: str) -> DataFrame:
    """Blocks together, in order."""
    held = nodes.withColumn("block", F.shiftright("idx", levels))
    return held.repartition("part", "block").sortWithinPartitions("part", "block", *first, "idx")


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """NODE: the root of every block."""

    def climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: Block | None = None
        for part, block, n, digest in _rows(batches):
            if held is None or (part, block) != (held.part, held.block):
                if held is not None:
                    out.append((held.part, held.block, -(-held.n >> levels), held.root))
                held = Block(part, block, n, levels)
            held.add(digest)
            if len(out) >= 10_000:
                yield _batch(out, NODE_TYPES)
                out = []
        if held is not None:
            out.append((held.part, held.block, -(-held.n >> levels), held.root))
            yield _batch(out, NODE_TYPES)

    return _swept(nodes, levels).select("part", "block", "n", "digest").mapInArrow(climbed, NODE)


NODE_TYPES = {"part": pa.string(), "idx": pa.int64(), "n": pa.int64(), "digest": pa.binary()}
SUFFIX_TYPES = {"part": pa.string(), "idx": pa.int64(), "proof": pa.list_(pa.string()), "subroot": pa.binary(), "root": pa.binary()}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def _down(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """SUFFIX: the proof of every node, from those of the roots of their blocks."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block | None = None
        for part, block, n, digest, proof, subroot, root in _rows(batches):
            if digest is None:
                held, message = None, (part, block, proof, subroot, root)
                continue
            if held is None:
                held = Block(part, block, n, levels)
            held.add(digest)
            if len(held.levels[0]) == held.size:
                part, block, proof, subroot, root = message
                proofs = held.suffixes(proof)
                for at in range(0, len(proofs), 1024):
                    yield _batch([(part, (block << levels) + i, proofs[i], subroot, root) for i in range(at, min(at + 1024, len(proofs)))], SUFFIX_TYPES)

    # A block's message comes before its nodes.
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    messages = above.select("part", F.shiftleft("idx", levels).alias("idx"), none("n", "long"), none("digest", "binary"), "proof", "subroot", "root", F.lit(0).alias("turn"))
    rows = nodes.select("part", "idx", "n", "digest", none("proof", "array<string>"), none("subroot", "binary"), none("root", "binary"), F.lit(1).alias("turn"))
    both = _swept(messages.unionByName(rows), levels, "turn")
    return both.select("part", "block", "n", "digest", "proof", "subroot", "root").mapInArrow(told, SUFFIX)


def _climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes below each round, and the root of every part."""
    rounds, roots = [], None
    while True:
        rounds.append(nodes)
        nodes = stored(_up(nodes, levels))
        top = nodes.where("n = 1")
        roots = top if roots is None else roots.unionByName(top)
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return rounds, roots


def _descend(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """SUFFIX of the leaves of ``rounds``, from those of the roots of all parts, which may end in any round."""
    known = None
    for depth in range(len(rounds) - 1, -1, -1):
        # Parts that end in this round: their nodes fit one block.
        ending = tops.join(rounds[depth].where((F.col("idx") == 0) & (F.col("n") <= 1 << levels)).select(F.col("part").alias("p")), F.col("part").eqNullSafe(F.col("p")), "left_semi")
        above = ending if known is None else known.unionByName(ending)
        known = _down(rounds[depth], above, levels)
        if depth:
            known = stored(known)
    return known


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, part: str = "lang", order: str = "doc_id", changes: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(order, leaf, subroot, root, proof) of every row: digests as hex text, and the steps from the leaf to the root.

    ``changes`` gives further digests of a row by name, each a Column of digests or null (``digest_of``).
    """
    more = changes or {}
    leaves = docs.select(
        docs[part].cast("string").alias("part"), docs[order].cast("long").alias("id"), digest_of([docs[c] for c in columns]).alias("digest"), *[c.alias(k) for k, c in more.items()]
    )
    leaves = stored(_ranked(leaves, ["id", "digest"]))
    rounds, subroots = _climb(leaves.select("part", "idx", "n", "digest"), levels)
    # The tree of subroots: its leaves are the parts, by name.
    tops = stored(_ranked(subroots.select(F.lit("").alias("part"), F.col("part").alias("name"), "digest"), ["name"]))
    upper, root = _climb(tops.select("part", "idx", "n", "digest"), levels)
    whole = root.select("part", "idx", F.array().cast("array<string>").alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    told = _descend(upper, whole, levels).select("idx", "proof", "root")
    named = stored(tops.join(told, "idx").select(F.col("name").alias("part"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot"), "root"))
    proofs = _descend(rounds, named, levels)
    proofs = proofs.select(F.col("part").alias("p"), F.col("idx").alias("i"), "proof", "subroot", "root")
    # Both sides have one row for every leaf.
    both = leaves.join(proofs, F.col("part").eqNullSafe(F.col("p")) & (F.col("idx") == F.col("i")))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return both.select(F.col("id").alias(order), F.lower(F.hex("digest")).alias("leaf"), text("subroot"), text("root"), "proof", *[text(k) for k in more])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to along ``proof``."""

    def step(digest: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith(LEFT), F.concat(other, digest)).when(s.startswith(RIGHT), F.concat(digest, other)).otherwise(digest).cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, from the leaf to the root."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.substring(s, 2, 64))).cast("binary"), 256)
