"""Row identity, seeded subsamples and seeded splits without a one-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_POSITION_MASK = (1 << 33) - 1


def assign_row_id(df: DataFrame, order_by: Sequence[str], name: str = "row_id", partitions: int | None = None) -> DataFrame:
    """0-based position in the declared total order.

    Rows are range-partitioned on the whole key, so a frequent leading value still
    spreads out. The partitioned rows are checkpointed once: the boundaries are sampled,
    and a second evaluation could draw others. Only the partition sizes reach the driver.
    """
    spread = (
        df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    ).sortWithinPartitions(*order_by)
    placed = cut_lineage(
        spread.withColumn("__part", F.spark_partition_id()).withColumn(
            "__pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))
        )
    )
    offsets, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect()):
        offsets[part] = total
        total += n
    if not offsets:
        return placed.withColumn(name, F.col("__pos")).drop("__part", "__pos")
    lookup = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return placed.withColumn(name, lookup[F.col("__part")].cast("bigint") + F.col("__pos")).drop("__part", "__pos")


def _draw(id_column: str, seed: int) -> Column:
    """60 bits of the md5 digest of "seed|id", which other engines compute as well."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def first_by_hash(df: DataFrame, id_column: str, n: int, seed: int) -> Column:
    """A flag that is true for exactly ``n`` rows, chosen by seeded hash of the identity.

    One pass counts rows per hash prefix (65 536 counters at most); a second looks only
    into the prefix where the cut falls. The flag itself is a plain row-wise comparison.
    """
    if n <= 0:
        return F.lit(False)
    draw = _draw(id_column, seed)
    prefix = F.shiftright(draw, 44)
    sizes = df.groupBy(prefix.alias("prefix")).count()
    running = sizes.withColumn("upto", F.sum("count").over(Window.orderBy("prefix")))
    cut = running.where(F.col("upto") >= n).orderBy("prefix").head()
    if cut is None:
        return F.lit(True)
    wanted = n - (cut["upto"] - cut["count"])
    inside = df.where(prefix == cut["prefix"]).select(draw.alias("h"), F.col(id_column).alias("i"))
    last = (
        inside.withColumn("rn", F.row_number().over(Window.orderBy("h", "i")))
        .where(F.col("rn") == wanted)
        .head()
    )
    return (draw < F.lit(last["h"])) | ((draw == F.lit(last["h"])) & (F.col(id_column) <= F.lit(last["i"])))


def subsample(df: DataFrame, cap: int, seed: int, id_column: str = "row_id") -> DataFrame:
    """At most ``cap`` rows, the same ones for the same seed however the table is partitioned."""
    return df.where(first_by_hash(df, id_column, cap, seed))


def train_validation_split(df: DataFrame, ratio: float, seed: int, id_column: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(train, validation) with exactly ``int(rows * ratio)`` validation rows."""
    n_val = int(df.count() * ratio)
    chosen = first_by_hash(df, id_column, n_val, seed)
    return df.where(~chosen), df.where(chosen)
