"""Near-duplicate documents by BagMinHash signatures of word shingles.

A text is the bag of its five-word shingles (A to Z lowered). Every shingle with weight ``w`` runs
Poisson processes over the discretised weights 1, 2, 3, ...: one for the first unit and one for
each dyadic range (1, 2], (2, 4], ... that its weight reaches, with the rate of the range's width;
points above the weight are thinned out. A point falls on one of the signature's slots and the
earliest point of a slot stays, so two bags agree in a slot with the probability of their weighted
Jaccard similarity. Points are made in the order of time and only while some slot is later.

Slots are banded; texts that share a band are checked against leaders of the bucket (see
``links``) by the exact weighted Jaccard similarity of their bags. With 24 bands of 6 slots a pair
of similarity 0.8 shares a bucket with probability 0.9993, one of 0.85 with 0.99999.

Equal texts are one vertex whatever their number. Texts of fewer than ``MIN_SHINGLES`` shingles
can reach the threshold only with an equal bag, so the bag itself is their band.

Defined cases: null texts are empty, and texts without words are near no other; a text of one to
four words is one shingle; null ids belong to the class of their text but never name it (null if
no row of the class has an id); repeated rows are copies; an empty table gives an empty result;
other columns are not looked at by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import links
from .common import _STEP, mix, shingles, slices, stored, text_bytes, whole_text, words_of

WIDTH = 5
THRESHOLD = 0.8
BANDS = 24
SLOTS = 6
MIN_SHINGLES = 4


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, weight) of every different shingle of some texts, sorted by text."""
    owner, _, _, words = words_of(data, offsets)
    at, found = shingles(owner, words, WIDTH)
    holder = owner[at]
    n_words = np.bincount(owner, minlength=len(offsets) - 1)
    few = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    if len(few):
        first = np.searchsorted(owner, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(WIDTH - 1):
            there = n_words[few] > k
            short[there] = (short[there] + words[first[there] + k]) * _STEP
        holder, found = np.concatenate([holder, few]), np.concatenate([found, mix(short + n_words[few].astype(np.uint64))])
    order = np.lexsort((found, holder))
    holder, found = holder[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (holder[1:] != holder[:-1])
    start = np.flatnonzero(new)
    return holder[start], found[start], np.diff(np.append(start, len(found)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(holder: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, slots: int = BANDS * SLOTS) -> np.ndarray:
    """(text, slot): the earliest point of each slot; infinite for texts without shingles."""
    ranges = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    which = np.repeat(np.arange(len(weight)), ranges)
    level = np.arange(len(which)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    width = np.where(level == 0, 1.0, low)
    top = weight[which].astype(np.float64)
    text = holder[which]
    seed = mix(shingle[which] + _STEP * (level + 1).astype(np.uint64))
    time = np.zeros(len(which))
    out = np.full(texts * slots, np.inf)
    turn = 0
    while len(which):
        turn += 1
        draw = mix(seed + np.uint64(2 * turn * 0xD6E8FEB86659FD93 % (1 << 64)))
        time = time - np.log(_uniform(draw)) / width
        draw = mix(draw ^ np.uint64(0xA0761D6478BD642F))
        slot = ((draw >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        # Points above an element's weight don't count, but the process goes on.
        counts = low + width * _uniform(mix(draw + _STEP)) <= top
        np.minimum.at(out, (text * slots + slot.astype(np.int64))[counts], time[counts])
        latest = out.reshape(texts, slots).max(axis=1)
        on = time < latest[text]
        which, low, width, top, text, seed, time = which[on], low[on], width[on], top[on], text[on], seed[on], time[on]
    return out.reshape(texts, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(text, band): a 64-bit key of the slots of each band."""
    raw = signature.view(np.uint64).reshape(len(signature), bands, signature.shape[1] // bands)
    key = np.broadcast_to(_STEP * np.arange(1, bands + 1, dtype=np.uint64), raw.shape[:2]).copy()
    for k in range(raw.shape[2]):
        key = mix(key + raw[:, :, k] * _STEP)
    return key.view(np.int64)


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Band keys of every text of a batch."""
    out: list[np.ndarray] = []
    for first, end in slices(batch, "text"):
        data, offsets = text_bytes(batch, "text", first, end)
        holder, shingle, weight = bags(data, offsets)
        n = end - first
        total = np.bincount(holder, weights=weight, minlength=n)
        large = total >= MIN_SHINGLES
        keys: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        # Small bags are their own band.
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, holder, mix(shingle) * weight.astype(np.uint64))
        for i in np.flatnonzero((total > 0) & ~large):
            keys[i] = mix(sums[i : i + 1]).view(np.int64)
        index = np.cumsum(large) - 1
        kept = large[holder]
        found = band_keys(signatures(index[holder[kept]], shingle[kept], weight[kept], int(large.sum())))
        for i, row in zip(np.flatnonzero(large), found, strict=True):
            keys[i] = row
        out += keys
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags, each sorted shingles and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / max(a[1].sum() + b[1].sum() - shared, 1))


def similarities(bags_: list[tuple[np.ndarray, np.ndarray]], columns: int = 1 << 14) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of some bags.

    A shingle of weight ``w`` stands for its first to ``w``-th occurrence, so the overlap of two
    bags is a product of zeros and ones, summed over occurrences that two bags have at least.
    """
    sizes = np.array([w.sum() for _, w in bags_])
    holder = np.repeat(np.arange(len(bags_)), sizes)
    shingle = np.concatenate([np.repeat(x, w) for x, w in bags_])
    first = np.repeat(np.cumsum(np.concatenate([w for _, w in bags_])) - np.concatenate([w for _, w in bags_]), np.concatenate([w for _, w in bags_]))
    occurrence = (np.arange(len(shingle)) - first).astype(np.uint64)
    order = np.argsort(key := mix(shingle + _STEP * occurrence), kind="stable")
    key, holder = key[order], holder[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(start, len(key)))
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    shared = np.repeat(count > 1, count)
    column, holder = column[shared], holder[shared]
    overlap = np.zeros((len(bags_), len(bags_)))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (begin, begin + columns))
        part = np.zeros((len(bags_), columns), np.float32)
        part[holder[a:b], column[a:b] - begin] = 1
        overlap += part @ part.T
    np.fill_diagonal(overlap, sizes)
    return overlap / np.maximum(sizes[:, None] + sizes[None, :] - overlap, 1)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    _, shingle, weight = bags(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return shingle, weight


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _linked(texts: DataFrame, threshold: float):
    """The two checks that ``links.classes`` asks for, by the texts (v, text) of all vertices."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}

        def of(key: bytes, text) -> tuple:
            if key not in held:
                if len(held) >= 64:
                    held.clear()
                held[key] = bag(text.as_buffer().to_pybytes())
            return held[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = [similarity(bag(x.as_buffer().to_pybytes()), of(j, y)) >= threshold for j, x, y in zip(b, batch.column("ta"), batch.column("tb"), strict=True)]
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.binary()) for x in (a, b)], names=["a", "b"])

    def linked(pairs: DataFrame) -> DataFrame:
        first = pairs.hint("merge").join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a")
        both = first.hint("merge").join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
        return stored(both.select("a", "b", "ta", "tb").mapInArrow(checked, "a binary, b binary"))

    def in_block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("v")
        names, group = list(frame["v"]), frame["c"].to_numpy()
        hold = similarities([bag(t.encode()) for t in frame["text"]]) >= threshold
        class_of = {c: c for c in group}

        def top(c):
            while class_of[c] != c:
                c = class_of[c]
            return c

        found = []
        for i, j in zip(*np.nonzero(np.triu(hold & (group[:, None] != group[None, :]), 1)), strict=True):
            a, b = top(group[i]), top(group[j])
            if a != b:  # one link is enough for two classes
                class_of[a] = b
                found.append((names[i], names[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    def linked_blocks(blocks: DataFrame) -> DataFrame:
        return stored(blocks.hint("merge").join(texts, "v").groupBy("g").applyInPandas(in_block, "a binary, b binary"))

    return linked, linked_blocks


def _text_classes(own: DataFrame, threshold: float) -> DataFrame:
    """(v, c) of the texts of ``own`` (v, text) that have a near-duplicate."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(_keys(batch), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("v"), keys], names=["v", "bands"])

    hashed = stored(own.select("v", "text").mapInArrow(banded, "v binary, bands array<long>"))
    members = hashed.groupBy("v").agg(F.first("bands").alias("bands")).select(F.explode("bands").alias("k"), "v")
    live = links.shared(members)
    # The texts that share a bucket with another, once each.
    # Texts meet ids by sorting at every size, so that costs grow in proportion and nothing is broadcast.
    texts = stored(own.join(live.select("v").distinct().hint("merge"), "v", "left_semi").groupBy("v").agg(F.first("text").alias("text")))
    return links.classes(live, *_linked(texts, threshold))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size) of every document; the class id is its smallest doc_id."""
    body = whole_text(docs, text)
    own = docs.select(docs[id_column].cast("long").alias("doc_id"), body.alias("text"), _digest(body).alias("v"))
    found = _text_classes(own, threshold)
    empty = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0
    # Texts without words are no copies of each other: each row is a class of its own.
    keys = stored(own.select("doc_id", "v", empty.alias("empty")))
    full = keys.where(~F.col("empty")).join(found, "v", "left").select("doc_id", F.coalesce("c", "v").alias("c"))
    sizes = full.groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    alone = keys.where("empty").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return full.join(sizes, "c").select("doc_id", "class_id", "class_size").unionByName(alone)


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one row of every class left: the one of the smallest id, null ids last."""
    body = whole_text(docs, text)
    own = docs.select(body.alias("text"), _digest(body).alias("v"))
    found = _text_classes(own, threshold)
    empty = F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")) == 0
    found = found.hint("merge")
    slim = docs.select(docs[id_column].alias("id"), _digest(body).alias("v"), empty.alias("empty")).where(~F.col("empty"))
    # Null ids sort last; equal ids are told apart by their text.
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("v"))
    first = slim.join(found, "v", "left").groupBy(F.coalesce("c", "v").alias("c")).agg(F.min(place).alias("first"))
    winners = stored(first.select(F.col("first.v").alias("v"), F.col("first.id").alias("first_id")))
    row = F.struct(*[docs[c] for c in docs.columns])
    packed = docs.select(row.alias("row"), _digest(body).alias("v"), empty.alias("empty"), docs[id_column].alias("id"))
    own_id = (F.col("id") == F.col("first_id")) | (F.col("id").isNull() & F.col("first_id").isNull())
    # Texts move once: repeated rows of one id lie in the same partition as they do after the join.
    kept = packed.where(~F.col("empty")).join(winners.hint("merge"), "v").where(own_id).groupBy("v").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(packed.where("empty").select("row.*"))
