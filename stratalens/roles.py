"""Column roles by naming rule; metadata only, no job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ID_COLUMN = "row_id"
TARGET_PREFIX = "target_"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def feature_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if f.name != ID_COLUMN and not f.name.startswith(TARGET_PREFIX) and is_numeric(f.dataType)
    ]


def target_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(TARGET_PREFIX)]


def extra_columns(df: DataFrame, features: list[str], id_column: str = ID_COLUMN) -> list[str]:
    """Numeric (or boolean) columns that are neither chosen features nor the identity."""
    return [f.name for f in df.schema.fields if f.name not in features and f.name != id_column and is_numeric(f.dataType)]
