"""Language-model scores by deleted interpolation.

The probability of a token mixes maximum-likelihood estimates of orders one to three with the
uniform one. The weights depend on how often the context was seen (a bucket per power of two) and
are learnt by expectation-maximisation on a fold of the training texts whose counts are left out
of the estimates meanwhile. An order whose context was not seen gives the estimate of the order
below, so that every mixture is a distribution.

Words, pairs and triples of words of all training texts are counted, whatever their frequency, words
by 64-bit hashes (some two of n are taken for one with a chance of about n * n / 2 ** 65), pairs and
triples by 56 bits (of n different ones about n * n / 2 ** 57 are taken for another: under a
hundred of three thousand million). Texts are put
into batches of about ``BATCH_BYTES``, written once. A batch sends each of its keys once, sorted
and cut into ranges; a range adds up its keys over all batches and answers every batch in the order
it asked, so that neither tables of counts nor keys go back. Nothing of them is gathered on the driver.

For EM a token counts by its bucket and the ratios of its estimates to the uniform one, rounded
to a quarter of a power of two, so that one pass over the left-out fold serves all rounds.

Tokens are the words between white space (space, tab to return) with A to Z lowered, then one end.

Defined cases: a null text is empty and has the end only; without training texts every score is
0; tokens unknown to training share the uniform estimate; repeated rows are scored (and learnt
from) one by one, null ids count as training; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, fold_of, mix, stored, whole_text, words_of

FOLDS = 7
HELD_OUT = 2
#: The training fold left out of the estimates while the weights are learnt.
DELETED = 3
BATCH_BYTES = 4 << 20
#: Bytes of text whose keys of one order meet in one range, about.
RANGE_BYTES = 8 << 20
ROUNDS = 60
BUCKETS = 64

#: Pairs and triples, which are most of what is sent, leave out the low byte.
KEPT_BITS = np.uint64(0xFFFFFFFFFFFFFF00)

START, END = np.uint64(1), np.uint64(2)

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(x: np.ndarray) -> bytes:
    """Eight-byte numbers by planes of bytes, without the highest planes that are zero.

    Planes are compressed one by one, as the low ones of keys are random and the high ones are not:
    number of planes, their lengths, the planes; one that gains nothing stands as it is.
    """
    if not len(x):
        return b""
    planes = x.view(np.uint8).reshape(-1, 8).T[: max(1, -(-int(x.max()).bit_length() // 8))]
    parts = [plane.tobytes() for plane in planes]
    parts = [min(raw, pa.compress(raw, "zstd", asbytes=True), key=len) for raw in parts]
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        n_planes = int(np.frombuffer(raw, np.uint32, 1)[0])
        end = 4 * (n_planes + 1)
        for i, length in enumerate(np.frombuffer(raw, np.uint32, n_planes, 4).tolist()):
            part, end = raw[end : end + length], end + length
            out[:, i] = np.frombuffer(part if len(part) == n else pa.decompress(part, n, "zstd", asbytes=True), np.uint8)
    return out.view(np.uint64).ravel()


def _batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """(b, fold, ids, data, offsets): compressed texts of one kind of fold in rows of about ``batch_bytes``; all training folds but ``DELETED`` are fold -1."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list[bytes]]] = {f: ([], []) for f in (-1, HELD_OUT, DELETED)}
        size = dict.fromkeys(held, 0)

        def row(fold: int) -> pa.RecordBatch:
            ids, texts = held[fold]
            offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
            columns = [pa.array([fold], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary()), pa.array([offsets.tobytes()], pa.binary())]
            held[fold], size[fold] = ([], []), 0
            return pa.RecordBatch.from_arrays(columns, names=["fold", "ids", "data", "offsets"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary() if pa.types.is_string(batch.column(2).type) else pa.large_binary())
            for i, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                kind = fold if fold in held else -1
                held[kind][0].append(i)
                held[kind][1].append(text.as_py())
                size[kind] += len(held[kind][1][-1])
                if size[kind] >= batch_bytes:
                    yield row(kind)
        for kind in held:
            if held[kind][0]:
                yield row(kind)

    rows = docs.select("doc_id", "fold", "text").mapInArrow(gathered, "fold int, ids array<long>, data binary, offsets binary")
    return stored(rows.select(F.monotonically_increasing_id().alias("b"), "fold", "ids", "data", "offsets"))


def hashes(data: bytes, offsets: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first token of every text, hash of every token) of a batch."""
    at = np.frombuffer(offsets, np.int64)
    raw = np.frombuffer(pa.decompress(data, int(at[-1]), "zstd"), np.uint8)
    owners, words = [], []
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), side="right")) - 1)
        owner, _, _, found = words_of(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        owners.append(owner + i)
        words.append(found)
        i = j
    length = np.bincount(np.concatenate(owners), minlength=len(at) - 1) + 1
    after = np.cumsum(length)
    w = np.full(after[-1], END)
    inside = np.ones(len(w), bool)
    inside[after - 1] = False
    w[inside] = np.concatenate(words)
    return after - length, w


def keys(first: np.ndarray, w: np.ndarray, order: int) -> np.ndarray:
    """Key of every token with the ``order - 1`` before it; at order three the first token of a text has none."""
    if order == 1:
        return mix(w)
    before = np.append(START, w[:-1])
    before[first] = START
    if order == 2:
        return mix(mix(before + _STEP) + w) & KEPT_BITS
    later = np.ones(len(w), bool)
    later[first] = False
    twice = np.append(START, before[:-1])
    return mix(mix(mix(twice + _STEP * np.uint64(3)) + before) + w)[later] & KEPT_BITS


def _edges(n: int) -> np.ndarray:
    """First key of every one of ``n`` ranges; its low byte is zero, as in the keys of pairs and triples."""
    return np.array([(i << 56) // n << 8 for i in range(n)], np.uint64)


def counts(batches: DataFrame, n_ranges: int) -> DataFrame:
    """(b, o, p, c, kept, sums): for the different keys of order ``o`` of a batch in range ``p``, in their
    order, how often all training texts and (for the left-out fold) those outside it have them.

    A row without ``b`` has the sums of a range: tokens, different keys, and both outside the left-out fold.
    """

    def asked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(n_ranges)
        for batch in rows:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                first, w = hashes(row["data"], row["offsets"])
                for o in (1, 2, 3):
                    found, n = np.unique(keys(first, w, o), return_counts=True)
                    at = np.append(np.searchsorted(found, edges), len(found))
                    parts = [(p, int(x), int(y)) for p, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
                    n = n.astype(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["b"]] * len(parts), pa.int64()), pa.array([row["fold"]] * len(parts), pa.int32()), pa.array([o] * len(parts), pa.int32()),
                            pa.array([p for p, _, _ in parts], pa.int32()), pa.array([y - x for _, x, y in parts], pa.int32()),
                            pa.array([packed(np.diff(found[x:y], prepend=edges[p])) for p, x, y in parts], pa.binary()),
                            pa.array([packed(n[x:y]) if row["fold"] != HELD_OUT else b"" for _, x, y in parts], pa.binary()),
                        ],
                        names=["b", "fold", "o", "p", "size", "keys", "n"],
                    )

    def summed(table: pa.Table) -> pa.Table:
        o, p = table["o"][0].as_py(), table["p"][0].as_py()
        size, fold = table["size"].to_numpy(), table["fold"].to_numpy()
        edge = _edges(n_ranges)[p]
        found = np.concatenate([np.cumsum(unpacked(raw.as_py(), n), dtype=np.uint64) + edge for raw, n in zip(table["keys"], size, strict=True)])
        n = np.concatenate([unpacked(raw.as_py(), n) if f != HELD_OUT else np.zeros(n, np.uint64) for raw, n, f in zip(table["n"], size, fold, strict=True)])
        _, inverse = np.unique(found, return_inverse=True)
        each = np.repeat(fold, size)
        # Sums stay below 2 ** 53.
        c, kept = (np.bincount(inverse, np.where(x, n, 0)).astype(np.uint64) for x in (each != HELD_OUT, each == -1))
        at = np.append(0, np.cumsum(size))
        rows = [inverse[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        sums = [int(c.sum()), int((c > 0).sum()), int(kept.sum()), int((kept > 0).sum())]
        return pa.table(
            [
                pa.array([*table["b"].to_pylist(), None], pa.int64()), pa.array([o] * (len(rows) + 1), pa.int32()), pa.array([p] * (len(rows) + 1), pa.int32()),
                pa.array([*(packed(c[x]) for x in rows), None], pa.binary()), pa.array([*(packed(kept[x]) if f == DELETED else None for x, f in zip(rows, fold, strict=True)), None], pa.binary()),
                pa.array([*[None] * len(rows), sums], pa.list_(pa.int64())),
            ],
            names=["b", "o", "p", "c", "kept", "sums"],
        )

    blocks = batches.select("b", "fold", "data", "offsets").mapInArrow(asked, "b long, fold int, o int, p int, size int, keys binary, n binary")
    return stored(blocks.groupBy("o", "p").applyInArrow(summed, "b long, o int, p int, c binary, kept binary, sums array<long>"))


def estimates(first: np.ndarray, c: list[np.ndarray], total: int, texts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bucket of the context's frequency, estimates of order one to three) of the tokens of texts that
    start at ``first``, from the counts of their keys; order three counts nothing for first tokens."""
    one = c[0] / max(total, 1)
    before = np.append(0, c[0][:-1])
    before[first] = texts
    twice = np.append(0, c[1][:-1])
    twice[first] = texts
    two = np.where(before > 0, c[1] / np.maximum(before, 1), one)
    # Before a text there is nothing but its start, however many words are looked at.
    third = c[1].copy()
    later = np.ones(len(one), bool)
    later[first] = False
    third[later] = c[2]
    three = np.where(twice > 0, third / np.maximum(twice, 1), two)
    return np.minimum(np.frexp(twice.astype(np.float64))[1], BUCKETS - 1), [one, two, three]


def learn_weights(bucket: np.ndarray, ratios: np.ndarray, n: np.ndarray, buckets: int) -> np.ndarray:
    """(bucket, order) mixture weights by EM; ``ratios`` are estimates over the uniform one, ``n`` how many tokens have them.

    One token of each order is added everywhere, so that no weight is zero; buckets without
    tokens take the weights of all tokens together.
    """

    def em(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        weights = np.full(x.shape[1], 1 / x.shape[1])
        for _ in range(ROUNDS):
            mixed = x * weights
            total = (mixed / mixed.sum(1, keepdims=True) * n[:, None]).sum(0) + 1.0
            weights = total / total.sum()
        return weights

    x = np.concatenate([np.ones((len(n), 1)), ratios], axis=1)
    out = np.tile(em(x, n), (buckets, 1))
    for b in np.unique(bucket):
        out[b] = em(x[bucket == b], n[bucket == b])
    return out


def _scored(batches: DataFrame, found: DataFrame, n_ranges: int, column: str, scored, schema: str) -> DataFrame:
    """``scored(row of a batch, first tokens, counts of the keys of order one to three)`` for every batch."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        answers = {(o, p): i for i, (o, p) in enumerate(zip(right["o"].to_pylist(), right["p"].to_pylist(), strict=True))}
        edges = _edges(n_ranges)
        first, w = hashes(row["data"], row["offsets"])
        c = []
        for o in (1, 2, 3):
            different, inverse = np.unique(keys(first, w, o), return_inverse=True)
            size = np.diff(np.append(np.searchsorted(different, edges), len(different)))
            parts = [unpacked(right[column][answers[o, p]].as_py(), n) for p, n in enumerate(size.tolist()) if n]
            c.append(np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.int64)[inverse])
        return scored(row, first, c)

    answers = found.where(F.col("b").isNotNull()).select("b", "o", "p", column)
    return batches.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(score, schema)


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """SCHEMA for every document."""
    key = docs[id_column].cast("long")
    own = docs.select(key.alias("doc_id"), fold_of(key, FOLDS).alias("fold"), whole_text(docs, text).alias("text"))
    batches = _batches(own, batch_bytes)
    sizes = {r.fold: r for r in batches.groupBy("fold").agg(F.sum(F.size("ids")).alias("texts")).collect()}
    size = own.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    n_ranges = max(1, -(-size // RANGE_BYTES))
    texts_kept, texts = (sum(sizes[f].texts for f in folds if f in sizes) for folds in ((-1,), (-1, DELETED)))
    found = counts(batches, n_ranges)
    sums = found.where((F.col("o") == 1) & F.col("b").isNull()).agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(4)]).first()
    total, distinct, total_kept, distinct_kept = (x or 0 for x in sums)

    def binned(row, first, c) -> pa.Table:
        uniform = 1 / (distinct_kept + 1)
        bucket, orders = estimates(first, c, total_kept, texts_kept)
        with np.errstate(divide="ignore"):
            bins = [np.where(p > 0, np.round(4 * np.log2(np.maximum(p, 1e-300) / uniform)), -9999).astype(np.int64) for p in orders]
        rows, n = np.unique(np.stack([bucket.astype(np.int64), *bins], axis=1), axis=0, return_counts=True)
        return pa.table([pa.array(rows[:, i].astype(np.int32)) for i in range(4)] + [pa.array(n.astype(np.int64))], names=["bucket", "r1", "r2", "r3", "n"])

    bins = _scored(batches.where(F.col("fold") == DELETED), found.where(F.col("kept").isNotNull()), n_ranges, "kept", binned, "bucket int, r1 int, r2 int, r3 int, n long")
    # As many rows as there are different rounded ratios.
    seen = bins.groupBy("bucket", "r1", "r2", "r3").agg(F.sum("n").alias("n")).orderBy("bucket", "r1", "r2", "r3").toArrow()
    ratios = np.stack([np.where((r := seen[f"r{i}"].to_numpy()) == -9999, 0.0, np.exp2(np.clip(r, -4000, 4000) / 4)) for i in (1, 2, 3)], axis=1)
    weights = learn_weights(seen["bucket"].to_numpy(), ratios, seen["n"].to_numpy().astype(np.float64), BUCKETS)

    if not distinct:  # no training texts: only the uniform estimate, which is one
        weights[:] = [1.0, 0.0, 0.0, 0.0]

    def mixed(row, first, c) -> pa.Table:
        bucket, orders = estimates(first, c, total, texts)
        p = weights[bucket, 0] / (distinct + 1)
        for i, x in enumerate(orders, 1):
            p += weights[bucket, i] * x
        base = np.log10((c[0] + 1) / (total + (distinct + 1)))
        known, base, score = (np.add.reduceat(x, first) for x in ((c[0] > 0).astype(np.int64), base, np.log10(p)))
        n = len(first)
        columns = [pa.array(row["ids"], pa.int64()), pa.array([row["fold"] == HELD_OUT] * n), pa.array(np.diff(np.append(first, len(p)))), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return _scored(batches, found, n_ranges, "c", mixed, SCHEMA)
