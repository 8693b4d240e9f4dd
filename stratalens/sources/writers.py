"""Result tables and selection exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import feature_columns, target_columns


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a result table; an empty one keeps its header or schema."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        # Without any partition no file, and so no header, would be written.
        out = df if df.rdd.getNumPartitions() else df.repartition(1)
        out.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown table kind: {kind}")


def export_columns(df: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """Features first, then targets."""
    chosen = list(features) if features is not None else feature_columns(df)
    return chosen + [c for c in target_columns(df) if c not in chosen]


def export_selection(df: DataFrame, selection: DataFrame, path: str, features: Sequence[str] | None = None) -> None:
    rows = df.join(selection.select("row_id").distinct(), "row_id", "left_semi")
    write_table(rows.select(*[F.col(c) for c in export_columns(df, features)]), path, "csv")
