"""Running totals and tied ranks that hold up when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, hold

WINDOW_ROWS = 1_000_000


def running_total(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, bound: int = WINDOW_ROWS) -> DataFrame:
    """Adds ``name``: inclusive running total of ``value`` per ``by`` in ``order`` (unique per group).

    Up to ``bound`` rows a plain window does it. Beyond, rows are range-partitioned so a
    large group spreads over tasks; each part is summed on its own and shifted by the
    totals of the parts before it.
    """
    df = hold(df)
    if df.limit(bound + 1).count() <= bound:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order)))
    parts = cut_lineage(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    inner = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(order))
    return parts.join(shift, [*by, "__part"]).withColumn(name, inner + F.col("__shift")).drop("__part", "__shift")


def average_ranks(df: DataFrame, by: Sequence[str], column: str, bound: int = WINDOW_ROWS) -> DataFrame:
    """(by..., column, ties, avg_rank) per distinct value; ties share the mean of their ranks."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("ties"))
    upto = running_total(counts, by, column, "ties", "__upto", bound)
    return upto.withColumn("avg_rank", F.col("__upto") - (F.col("ties") - 1) / 2).drop("__upto")
