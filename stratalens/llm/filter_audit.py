"""Filter interaction audit: what every filter removes in every order, from one pass over the texts.

A document becomes a 32-bit survival word: bit S tells whether it survives the subset S of up to five
filters. The word is the conjunction of one truth-table constant for each filter that it fails. Words are added up
position by position with carry-save adders: three words of equal weight become a sum word and a
carry word of twice the weight, so a task keeps one word per power of two, part and label, however
many rows it reads. The counts by subset answer every order: the survivors of a prefix are the
survivors of its set.

Texts are read once, and only ids, digests and words leave that pass. Whether a smaller id has the
same text is known after one aggregation by digest, combined before the shuffle. Texts that make up more than a
``HOT``-th of all rows, of which there can be no more than ``HOT``, are looked up in a broadcast
table; their copies and rows without an id are spread by a salt in the joins that follow.

Defined cases: a null text is empty and a null part the empty string; a null id has no label, is
no copy of another row and makes none; rows that share an id and a text are copies of smaller ids
only, not of each other; several labels of an id count as good or toxic if one of them says so; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, whole_text

MOST_FILTERS = 5
ALL = 0xFFFFFFFF
#: Truth tables: bit S of the i-th is set unless filter i is in the subset S.
TRUTH = [sum(1 << s for s in range(32) if not s >> i & 1) for i in range(MOST_FILTERS)]
#: A text of more than this share of all rows is looked up by broadcast.
HOT = 1000
#: Sums of so many parts and labels are held by a task before it hands them on.
MOST_SUMS = 16_384


@dataclass(frozen=True)
class Filter:
    """``fails`` is a condition on the measures; a filter of copies has none."""

    name: str
    fails: Callable[[], Column] | None


FILTERS = (
    Filter("A", lambda: F.col("n_words") < 50),
    Filter("B", lambda: 100 * F.col("n_distinct") < 65 * F.col("n_words")),
    Filter("C", lambda: 100 * F.col("n_upper") > 5 * F.col("n_chars")),
    Filter("D", lambda: F.col("has_symbol")),
    Filter("E", None),
)


def _measured(docs: DataFrame, id_column: str, text: str, part: str) -> DataFrame:
    own = docs.select(docs[id_column].cast("long").alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), whole_text(docs, text).alias("text"))
    own = own.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), 1))
    return own.select(
        "id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"), F.length("text").alias("n_chars"), F.col("text").rlike("[#$%&*|]").alias("has_symbol"),
    )


def _word(failed: list[tuple[int, Column]]) -> Column:
    word = F.lit(ALL)
    for i, fails in failed:
        word = word.bitwiseAND(F.when(fails, F.lit(TRUTH[i])).otherwise(F.lit(ALL)))
    return word


def survival_words(docs: DataFrame, labels: DataFrame, filters=FILTERS, id_column: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, good, toxic, word) of every row of ``docs``."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    own = _measured(docs, id_column, text, part)
    tests = [(i, f.fails()) for i, f in enumerate(filters) if f.fails]
    own = stored(own.select("id", "part", "digest", _word(tests).alias("word")))
    copies = [(i, F.coalesce(F.col("first") < F.col("id"), F.lit(False))) for i, f in enumerate(filters) if not f.fails]
    if copies:
        again = stored(own.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        hot = F.col("n") * HOT > F.lit(own.count())
        # At most HOT rows, whatever the table holds.
        own = own.join(F.broadcast(again.where(hot).select("digest", F.col("first").alias("early"))), "digest", "left")
        own = own.withColumn("salt", F.when(F.col("early").isNotNull(), F.xxhash64("id")).otherwise(F.lit(0)))
        own = own.join(again.where(~hot).select("digest", "first", F.lit(0).cast("long").alias("salt")), ["digest", "salt"], "left")
        own = own.withColumn("first", F.coalesce("early", "first")).select("id", "part", "digest", F.col("word").bitwiseAND(_word(copies)).alias("word"))
    known = labels.groupBy(labels[id_column].cast("long").alias("id")).agg(*[F.max(F.coalesce(labels[c] == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    own = own.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    own = own.join(known.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    return own.select("id", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "word")


def added(words: np.ndarray, planes: list[int]) -> list[int]:
    """Carry-save sums: ``planes[k]`` holds bit k of the 32 counts; ``words`` are added to them."""
    out: list[int] = []
    level = words.astype(np.uint32)
    while len(level) or len(out) < len(planes):
        if len(out) < len(planes):
            level = np.append(level, np.uint32(planes[len(out)]))
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append(a & b | half & c)
            level = np.concatenate([half ^ c, level[3 * third :]])
        if len(level) == 2:
            carries.append(level[:1] & level[1:])
            level = level[:1] ^ level[1:]
        out.append(int(level[0]))
        level = np.concatenate(carries) if carries else level[:0]
    return out


def counts(planes: list[int]) -> list[int]:
    """How many of the added words have each of the 32 bits."""
    return [sum((plane >> s & 1) << k for k, plane in enumerate(planes)) for s in range(32)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, good, toxic, n): the 32 counts of a task's rows."""

    def out(held: dict) -> pa.RecordBatch:
        parts, good, toxic = zip(*held, strict=True)
        n = pa.array([counts(p) for p in held.values()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(good, pa.bool_()), pa.array(toxic, pa.bool_()), n], names=["part", "good", "toxic", "n"])

    held: dict[tuple[str, bool, bool], list[int]] = {}
    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        names = coded.dictionary.to_pylist()
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
        key = coded.indices.to_numpy().astype(np.int64) * 4 + good * 2 + toxic
        order = np.argsort(key, kind="stable")
        key, words = key[order], batch.column("word").to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for first, end in zip(starts, [*starts[1:], len(key)], strict=True):
            k = int(key[first])
            name = (names[k // 4], bool(k & 2), bool(k & 1))
            held[name] = added(words[first:end], held.get(name, []))
        if len(held) >= MOST_SUMS:
            yield out(held)
            held = {}
    if held:
        yield out(held)


def survivors(words: DataFrame) -> DataFrame:
    """(part, kept, good, toxic) of survival words: arrays of the survivors of each of the 32 subsets, of all rows, good ones and toxic ones."""
    sums = words.select("part", "good", "toxic", "word").mapInArrow(_sums, "part string, good boolean, toxic boolean, n array<long>")
    cells = sums.select("part", "good", "toxic", F.posexplode("n").alias("s", "m"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("m")).otherwise(0))
    cells = cells.groupBy("part", "s").agg(F.sum("m").alias("kept"), of("good").alias("good"), of("toxic").alias("toxic"))
    # 32 rows of a part.
    cells = cells.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "kept", "good", "toxic"))).alias("cells"))
    return cells.select("part", *[F.col(f"cells.{c}").alias(c) for c in ("kept", "good", "toxic")])


def audit(subsets: DataFrame, filters=FILTERS) -> DataFrame:
    """Every order of ``filters``, step by step, for every part of ``survivors``."""
    m = len(filters)
    steps = []
    for order in itertools.permutations(range(m)):
        name, before = "".join(filters[i].name for i in order), 0
        for step, i in enumerate(order):
            steps.append(F.struct(F.lit(name).alias("filter_order"), F.lit(step + 1).alias("step"), F.lit(i).alias("i"), F.lit(before).alias("before"), F.lit(before | 1 << i).alias("after")))
            before |= 1 << i
    whole = (1 << m) - 1
    lost = lambda c, a, b: F.get(c, a) - F.get(c, b)
    rest = F.array(*[F.lit(whole ^ 1 << i) for i in range(m)])
    shares = []
    for i in range(m):
        without = [s for s in range(1 << m) if not s >> i & 1]
        shares.append(sum((F.lit(math.factorial(s.bit_count()) * math.factorial(m - 1 - s.bit_count())) * lost("kept", F.lit(s), F.lit(s | 1 << i)) for s in without), F.lit(0)))
    wide = subsets.withColumn("shares", F.array(*shares)).select("part", "kept", "good", "toxic", "shares", F.inline(F.array(*steps)))
    removed = lost("kept", F.col("before"), F.col("after"))
    failing = F.get("kept", F.lit(0)) - F.get("kept", F.get(F.array(*[F.lit(1 << i) for i in range(m)]), F.col("i")))
    return wide.select(
        "part", "filter_order", "step", F.get("kept", F.col("after")).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        lost("kept", F.get(rest, F.col("i")), F.lit(whole)).alias("unique_fails"), lost("good", F.col("before"), F.col("after")).alias("good_lost"),
        lost("toxic", F.col("before"), F.col("after")).alias("toxic_lost"), F.get("shares", F.col("i")).alias("shapley"),
    )
