"""Reading and stacking raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, sep: str, schema: T.StructType | str) -> DataFrame:
    """Delimited text with a header; the schema is given, so the file is read once."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, mode="FAILFAST")


def read_result(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "csv") -> DataFrame:
    """A result table written earlier, read back with its declared schema."""
    if kind == "csv":
        return read_delimited(spark, path, ",", schema)
    if kind in ("json", "parquet"):
        return getattr(spark.read.schema(schema), kind)(path)
    raise ValueError(f"unknown table kind: {kind}")


def stack_sources(sources: dict[object, DataFrame], flag: str) -> DataFrame:
    """Stack tables of the same columns; ``flag`` tells which source a row came from."""
    if not sources:
        raise ValueError("nothing to stack")
    tagged = [df.withColumn(flag, F.lit(value)) for value, df in sources.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def rename_role(df: DataFrame, column: str, role: str) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.withColumnRenamed(column, role)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with fewer splits than cores, dealt out to all of them.

    A file of one row group is one task however many cores wait. Large tables have more
    splits than cores and are left alone. Only for scans: the number of splits is read off
    the plan without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
