"""Equal-width histograms and score summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite

BINS = 28
SCORE_BINS = 24


def column_histograms(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """(feature, bin, n, height): bins over [min, max], the last closed, a column without span in bin 0.

    Bounds are one row, sent along as literals; counting is one pass with map-side sums.
    """
    bounds = df.agg(*[F.struct(F.min(finite(c)).alias("lo"), F.max(finite(c)).alias("hi")).alias(c) for c in columns]).head()
    cells = []
    for c in columns:
        lo, hi = bounds[c]["lo"], bounds[c]["hi"]
        if lo is None:
            continue
        value = finite(c)
        ix = F.least(F.lit(bins - 1), F.floor((value - lo) / F.lit(hi - lo) * bins)) if hi > lo else F.lit(0)
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(value.isNotNull(), ix).cast("int").alias("bin")))
    counts = df.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.count("*").alias("n"))
    return _with_height(_all_bins(counts, ["feature"], bins), ["feature"])


def score_histogram(df: DataFrame, score: str, by: Sequence[str], bins: int = SCORE_BINS) -> DataFrame:
    """Fixed bins over [0, 1] per group; empty bins appear with 0."""
    value = finite(score)
    ix = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(value * bins))).cast("int")
    counts = df.where(value.isNotNull()).groupBy(*by, ix.alias("bin")).agg(F.count("*").alias("n"))
    return _with_height(_all_bins(counts, by, bins), by)


def _all_bins(counts: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    grid = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _with_height(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    peak = F.max("n").over(Window.partitionBy(*by))
    return counts.withColumn("height", F.col("n") / peak)


def score_summary(scores: DataFrame, by: Sequence[str] = ("node_id",)) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.max("outlier_score").alias("max_score"),
        F.avg("outlier_score").alias("mean_score"),
        F.count("outlier_score").alias("n_scored"),
    )
