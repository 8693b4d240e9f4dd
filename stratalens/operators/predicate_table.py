"""Predicates as a table: packed bounds, set beside the rows of their own scope by one join.

A predicate is one row with two arrays, the lower and upper bounds in column order (null where
it has no clause). Rows meet the predicates of their scope, or all where there is no scope, in one
scan whatever the number of predicates; nothing of them passes through the driver or the plan.
A table within ``BROADCAST_BYTES`` is broadcast. A larger one is joined by (scope, part): scopes of
more than ``PART_ROWS`` rows are dealt over parts, to each of which their predicates are copied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import hold

BROADCAST_BYTES = 64 << 20
PART_ROWS = 1 << 20
# The list of hot scopes is broadcast; rows per part grow with the input so that it stays short.
HOT_SCOPES = 1 << 16

PRED, LO, HI, SCOPE, PART = "__pred", "__lo", "__hi", "__scope", "__part"


def id_column(name: str) -> str:
    """An id of a predicate beside rows, whose own columns may have the same name."""
    return f"__id_{name}"


def packed(predicates: DataFrame, features: Sequence[str], ids: Sequence[str], active: Column | None = None) -> DataFrame:
    """(ids..., lo, hi): one row per predicate. Clauses that are not active count as absent."""
    on = F.col("feature").isin(list(features)) & (F.lit(True) if active is None else active)
    clause = F.struct("feature", F.struct(F.col("sel_min").cast("double").alias("lo"), F.col("sel_max").cast("double").alias("hi")))
    clauses = predicates.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.when(on, clause))).alias("__clauses"))
    order = F.array(*[F.lit(f) for f in features])
    bound = lambda side: F.transform(order, lambda f: F.try_element_at("__clauses", f)[side])
    return clauses.select(*ids, bound("lo").alias(LO), bound("hi").alias(HI))


def numbered(table: DataFrame, ids: Sequence[str], scope: Column | None = None) -> DataFrame:
    """(number, ids under their own names, [scope], other columns...), written once so that the numbers stay."""
    rest = [c for c in table.columns if c not in ids]
    # Read back from files: the number is part of what was written.
    return hold(
        table.select(
            F.monotonically_increasing_id().alias(PRED), *[F.col(c).alias(id_column(c)) for c in ids],
            *([scope.alias(SCOPE)] if scope is not None else []), *rest,
        )
    )


def named(counted: DataFrame, table: DataFrame, ids: Sequence[str], *others: str) -> DataFrame:
    """Counts per number under the names of the ids."""
    return counted.join(table.select(PRED, *[F.col(id_column(c)).alias(c) for c in ids]), PRED).select(*ids, *others)


def beside(rows: DataFrame, table: DataFrame, width: int, scope: str | None = None) -> DataFrame:
    """Every row beside the predicates of its scope (all predicates without one).

    ``table`` is ``numbered``; ``width`` is the number of its bounds. Rows without a scope meet nothing.
    """
    keys = [PART] + ([SCOPE] if scope else [])
    marked = rows.withColumn(SCOPE, F.col(scope)) if scope else rows
    spread = lambda parts: F.pmod(F.xxhash64(*rows.columns), parts).cast("int")
    copies = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    if table.count() * (32 * width + 512) <= BROADCAST_BYTES:
        return marked.withColumn(PART, spread(F.lit(1))).join(F.broadcast(table.withColumn(PART, copies(F.lit(1)))), keys)
    if not scope:
        parts = F.lit(int(1 + rows.count() // PART_ROWS))
        return marked.withColumn(PART, spread(parts)).join(table.withColumn(PART, copies(parts)), keys)
    sizes = hold(marked.where(F.col(SCOPE).isNotNull()).groupBy(SCOPE).agg(F.count("*").alias("n")))
    limit = max(PART_ROWS, (sizes.agg(F.sum("n")).head()[0] or 0) // HOT_SCOPES)
    hot = sizes.where(F.col("n") > limit).select(SCOPE, (1 + F.floor(F.col("n") / limit)).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    mine = marked.join(F.broadcast(hot), SCOPE, "left").withColumn(PART, spread(parts)).drop("__parts")
    theirs = table.join(F.broadcast(hot), SCOPE, "left").withColumn(PART, copies(parts)).drop("__parts")
    return mine.join(theirs, keys)


def within(value: str, i: int) -> str:
    """SQL test that a column lies within the i-th bounds; null where there are none."""
    return f"{value} between get({LO}, {i}) and get({HI}, {i})"
