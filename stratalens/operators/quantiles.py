"""Exact order statistics of many columns in many groups, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import aggregate_wide, melt
from ..session import hold

BINS = 1024
GROUP_LIMIT = 500_000


def extents(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., feature, n, lo, hi) in one pass."""
    return aggregate_wide(
        rows, keys, columns,
        {"n": lambda c: F.count(c), "lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")},
    ).where(F.col("n") > 0)


def _narrow(cells: DataFrame, keys: Sequence[str], open_ranks: DataFrame) -> DataFrame:
    """One refinement: count per equal-width bin, keep the bin that holds the rank."""
    at = [*keys, "feature"]
    inside = cells.join(open_ranks, at).where(F.col("value").between(F.col("lo"), F.col("hi")))
    slot = F.least(F.lit(BINS - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
    counts = inside.groupBy(*at, "rank", "below", slot.alias("slot")).agg(
        F.count("*").alias("inside"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    upto = F.sum("inside").over(Window.partitionBy(*at, "rank").orderBy("slot"))
    hit = counts.withColumn("upto", F.col("below") + upto)
    hit = hit.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("inside") <= F.col("rank")))
    return hit.select(*at, "rank", "lo", "hi", (F.col("upto") - F.col("inside")).alias("below"), "inside")


def value_ranks(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., feature, value, upto): distinct values with their running counts, for groups known to be small."""
    at = [*keys, "feature"]
    counted = melt(rows, keys, columns).groupBy(*at, "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*at).orderBy("value"))
    return counted.withColumn("upto", upto).drop("n")


def _settled(ranked: DataFrame, at: list[str], spots: DataFrame) -> DataFrame:
    first = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("value")))
    return ranked.join(spots, at).groupBy(*at, "target", "pos", "r0").agg(first("r0").alias("v0"), first("r1").alias("v1"))


def order_statistics(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], ranks: DataFrame, limit: int) -> DataFrame:
    """(keys..., feature, rank, value) for 0-based ``ranks`` (keys..., feature, rank, n, lo, hi) in large groups.

    Each pass is a scan with map-side counts that narrows every rank to one of 1024 bins.
    Once a rank's bin holds at most ``limit`` rows, its distinct values are counted and
    ranked. A bin of one single value is finished whatever its size, so frequent values
    need no further work.
    """
    at = [*keys, "feature"]
    cells = melt(rows, keys, columns)
    state = ranks.select(*at, "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"))
    wide = (F.col("inside") > limit) & (F.col("lo") < F.col("hi"))
    state = hold(state)
    while state.where(wide).limit(1).count():
        state = hold(state.where(~wide).unionByName(_narrow(cells, keys, state.where(wide))))
    done = state.where(F.col("lo") == F.col("hi")).select(*at, "rank", F.col("lo").alias("value"))
    inside = cells.join(state.where(F.col("lo") < F.col("hi")), at).where(F.col("value").between(F.col("lo"), F.col("hi")))
    counted = inside.groupBy(*at, "rank", "below", "value").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*at, "rank").orderBy("value"))
    found = counted.withColumn("upto", upto).where(F.col("upto") > F.col("rank"))
    return found.groupBy(*at, "rank").agg(F.min("value").alias("value")).unionByName(done)


def largest_group(ext: DataFrame) -> int:
    return ext.agg(F.max("n")).head()[0] or 0


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], targets: DataFrame, limit: int = GROUP_LIMIT,
    largest: int | None = None, ranked: DataFrame | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles (keys..., feature, target, value).

    ``targets`` holds (keys..., feature, n, lo, hi, target, p); ``p`` may differ per group
    and column, which the built-in exact percentile does not allow. ``largest`` is the
    size of the largest group where the caller already knows it, ``ranked`` the values'
    running counts where it keeps them for several calls.
    """
    at = [*keys, "feature"]
    spots = targets.withColumn("pos", F.col("p") * (F.col("n") - 1))
    spots = spots.withColumn("r0", F.floor("pos")).withColumn("r1", F.least(F.col("r0") + 1, F.col("n") - 1))
    if (largest_group(targets) if largest is None else largest) <= limit:
        out = _settled(value_ranks(rows, keys, columns) if ranked is None else ranked, at, spots.select(*at, "target", "pos", "r0", "r1"))
    else:
        ranks = spots.select(*at, "n", "lo", "hi", F.explode(F.array("r0", "r1")).alias("rank")).distinct()
        values = hold(order_statistics(rows, keys, columns, ranks, limit))
        low = values.withColumnsRenamed({"rank": "r0", "value": "v0"})
        high = values.withColumnsRenamed({"rank": "r1", "value": "v1"})
        out = spots.join(low, [*at, "r0"]).join(high, [*at, "r1"])
    value = F.col("v0") + (F.col("pos") - F.col("r0")) * (F.col("v1") - F.col("v0"))
    return out.select(*at, "target", value.alias("value"))


def medians(df: DataFrame, by: Sequence[str], columns: dict[str, Column | str]) -> DataFrame:
    """(by..., one column per entry of ``columns``): exact medians per group, null where a group has no value.

    Groups are compared like values of SQL's ``group by``: null keys are a group as well.
    """
    names = list(columns)
    keys = [f"__k{i}" for i in range(len(by))]
    plain = df.select(*[F.struct(F.col(k).alias("k")).alias(n) for k, n in zip(by, keys)], *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in columns.items()])
    plain = hold(plain)
    ext = hold(extents(plain, keys, names))
    found = exact_quantiles(plain, keys, names, ext.withColumns({"target": F.lit("median"), "p": F.lit(0.5)}), largest=largest_group(ext))
    pick = lambda n: F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n)
    groups = plain.select(*keys).distinct()
    wide = found.groupBy(*keys).agg(*[pick(n) for n in names])
    return groups.join(wide, keys, "left").select(*[F.col(f"{n}.k").alias(k) for k, n in zip(by, keys)], *names)


def with_medians(table: DataFrame, df: DataFrame, by: Sequence[str], columns: dict[str, Column | str]) -> DataFrame:
    """``table``, one row per group of ``df``, with its exact medians."""
    own = medians(df, by, columns)
    names = {k: f"__m_{k}" for k in by}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return table.join(own.withColumnsRenamed(names), same, "left").drop(*names.values())
