"""Session helpers: local sessions for tests, and tables between steps that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "stratalens") -> SparkSession:
    """A session for tests and the benchmark. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STRATALENS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local masters."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-stratalens-"))
    return sc.getCheckpointDir()


def _folder(spark: SparkSession) -> str:
    """Where this application keeps its tables, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def hold(df: DataFrame) -> DataFrame:
    """Write a result that later steps read again, and read it back.

    One path at every size: the rows are computed once, stay with the executors, cut the
    lineage and survive lost executors; the optimizer sees their size in the files. ``tidy``
    removes all tables of an application.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The same where a driver loop would otherwise grow the plan.
cut_lineage = hold


def tidy(spark: SparkSession) -> None:
    """Delete what ``hold`` has written for this application; its results must not be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
