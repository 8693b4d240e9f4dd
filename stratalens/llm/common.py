"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hold

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Tables between steps lie with those of the rest of the library, so that ``session.tidy`` removes them too.
stored = hold


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text modulo ``folds``; a null key falls in fold -1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)).cast("int"), F.lit(-1))


def slices(batch: pa.RecordBatch, column: str, at_most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first row, end row) ranges of a batch whose texts hold about ``at_most`` bytes, one row at least."""
    ends = np.frombuffer(batch.column(column).buffers()[1], dtype=_offset_type(batch.column(column)))[batch.column(column).offset :][: batch.num_rows + 1]
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(ends, ends[first] + at_most, side="right")) - 1
        end = min(max(end, first + 1), batch.num_rows)
        yield first, end
        first = end


def _offset_type(column: pa.Array):
    return np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32


def text_bytes(batch: pa.RecordBatch, column: str, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of rows ``first`` to ``end``; the column has no nulls."""
    array = batch.column(column)
    offsets = np.frombuffer(array.buffers()[1], dtype=_offset_type(array))[array.offset + first : array.offset + end + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[ord(x) for x in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the published SplitMix64 generator, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_R = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: int, size: int) -> np.ndarray:
    if len(_powers[name]) < size:
        steps = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:size]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first byte, end byte, 64-bit hash) of every word of some texts, in order.

    Hashes ignore the case of A to Z. One pass of prefix sums hashes all words at once.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    lowered = _LOWER[data]
    gap = _SPACE[lowered]
    opens = ~gap
    starts_text = np.zeros(n + 1, bool)
    starts_text[offsets] = True
    first = opens.copy()
    first[1:] &= gap[:-1] | starts_text[1:n]
    last = opens
    last[:-1] &= gap[1:] | starts_text[1:n]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[lowered] * _power("up", _R, n), out=sums[1:])
    hashes = (sums[end] - sums[begin]) * _power("down", pow(_R, -1, 1 << 64), n)[begin]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    return owner, begin, end, mix(hashes + _STEP * (end - begin).astype(np.uint64))


def shingles(owner: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``width`` words within one text."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[width - 1 :] == owner[: len(owner) - width + 1])
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out = (out + hashes[k : len(hashes) - width + 1 + k]) * _STEP
    return at, mix(out[at])
