"""Row-level expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(value: Column | str) -> Column:
    """Number or null: booleans become 0/1, text that is no number and NaN/Inf become null."""
    col = F.col(value) if isinstance(value, str) else value
    number = col.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def scaled_by_constant(df: DataFrame, columns: Sequence[str], divisor: float) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(divisor)) for c in columns})


def pixels(columns: Sequence[str]) -> Column:
    """Unit-interval pixel columns as one array of 0..255 integers, clipped and truncated."""
    levels = F.array(*[F.col(c).cast("double") for c in columns])
    return F.transform(levels, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v * 255)).cast("int"))


def one_hot(df: DataFrame, label: str, classes: Sequence[int], drop_label: bool = True) -> DataFrame:
    out = df.withColumns({f"target_{c}": F.col(label) == F.lit(c) for c in classes})
    return out.drop(label) if drop_label else out


def decode_one_hot(columns: Sequence[str]) -> Column:
    """Position of the first largest flag; a row with no flag set decodes to 0."""
    flags = F.array(*[F.col(c).cast("int") for c in columns])
    return (F.array_position(flags, F.array_max(flags)) - 1).cast("int")


def class_labels(df: DataFrame) -> Column | None:
    """Class id from the target columns, or None where the only target is continuous."""
    targets = [c for c in df.columns if c.startswith("target_")]
    if "target_is_red" in targets:
        return F.col("target_is_red").cast("int")
    if "target_manifold_position" in targets or not targets:
        return None
    return decode_one_hot(targets)


def ring_count(text: Column | str) -> Column:
    """Half the number of non-zero digits in the text, rounded down."""
    col = F.col(text) if isinstance(text, str) else text
    return F.floor(F.regexp_count(col, F.lit("[1-9]")) / 2).cast("int")


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(otherwise))


def f1_columns(tp: Column, predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    """(f1, precision, recall); every zero denominator gives 0."""
    precision = ratio(tp, predicted, 0.0)
    recall = ratio(tp, actual, 0.0)
    f1 = ratio(2 * precision * recall, precision + recall, 0.0)
    return f1, precision, recall


def aggregate_wide(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    measures: dict[str, Callable[[str], Column]],
    name: str = "feature",
) -> DataFrame:
    """Several measures of many columns in one pass, returned as one row per (group, column).

    The input is aggregated wide and only the result is turned long, so no row is
    multiplied by the number of columns.
    """
    exprs = [fn(c).alias(f"m{i}_{m}") for i, c in enumerate(columns) for m, fn in measures.items()]
    wide = df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias(name), *[F.col(f"m{i}_{m}").alias(m) for m in measures])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(*by, F.inline(rows))


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form (keep..., feature, value) without null values."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), finite(c).alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells)).where(F.col("value").isNotNull())
