"""Operators on rows: lookups, range filters, selection guards, ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import aggregate_wide, finite


def fetch_rows(df: DataFrame, ids: DataFrame, columns: Sequence[str] | None = None, id_column: str = "row_id") -> DataFrame:
    """Rows for the requested ids in request order.

    ``ids`` carries ``position`` and the id. ``columns=None`` means all columns, ``[]``
    none besides the id. Unknown columns and ids without a row are errors.
    """
    wanted = [c for c in df.columns if c != id_column] if columns is None else list(columns)
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    missing = ids.join(df.select(id_column), id_column, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} requested ids have no row")
    picked = df.select(id_column, *[c for c in wanted if c != id_column])
    return ids.select("position", id_column).join(picked, id_column).orderBy("position")


def column_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, lo, hi, usable): a column can be filtered when its finite bounds differ."""
    bounds = aggregate_wide(
        df, [], columns, {"lo": lambda c: F.min(finite(c)), "hi": lambda c: F.max(finite(c))}
    )
    return bounds.withColumn("usable", F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)))


def effective_windows(df: DataFrame, windows: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """The windows that constrain anything: known, usable and not covering the whole column."""
    known = [c for c in windows if c in df.columns]
    if not known:
        return {}
    kept = {}
    for r in column_bounds(df, known).collect():
        lo, hi = windows[r["feature"]]
        if r["usable"] and not (lo <= r["lo"] and hi >= r["hi"]):
            kept[r["feature"]] = (lo, hi)
    return kept


def range_filter(
    df: DataFrame, windows: dict[str, tuple[float, float]], id_column: str = "row_id"
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """((row_id, matches), effective clauses) for a conjunction of closed windows.

    Null never matches. With no effective clause there is no filtering at all, and
    ``matches`` is null rather than true.
    """
    clauses = effective_windows(df, windows)
    if not clauses:
        return df.select(id_column, F.lit(None).cast("boolean").alias("matches")), clauses
    test = F.lit(True)
    for c, (lo, hi) in clauses.items():
        test = test & F.coalesce(finite(c).between(lo, hi), F.lit(False))
    return df.select(id_column, test.alias("matches")), clauses


def usable_selection(space: DataFrame, selection: DataFrame, id_column: str = "row_id") -> str:
    """'empty', 'whole' or 'ok'. A selection of the whole space has nothing to contrast with."""
    chosen = selection.select(id_column).distinct().join(space.select(id_column), id_column, "left_semi").count()
    if chosen == 0:
        return "empty"
    return "whole" if chosen == space.count() else "ok"


def require_partial(space: DataFrame, selection: DataFrame, id_column: str = "row_id") -> bool:
    """False for an empty selection (answer: an empty table); a whole-space selection is refused."""
    state = usable_selection(space, selection, id_column)
    if state == "whole":
        raise ValueError("the selection covers the whole space")
    return state == "ok"


def top_outliers(scores: DataFrame, limit: int = 100, by: Sequence[str] = ("node_id",), id_column: str = "row_id") -> DataFrame:
    """The rows with the highest scores per node, nulls left out, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.col("outlier_score").desc(), F.col(id_column))
    ranked = scores.where(F.col("outlier_score").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit)


def with_full_rows(ranked: DataFrame, df: DataFrame, columns: Sequence[str], id_column: str = "row_id") -> DataFrame:
    return ranked.join(df.select(id_column, *columns), id_column)
