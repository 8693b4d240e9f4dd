"""Views of the given tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VECTOR_SIZE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem for work that costs more than the scan."""
    return spread(table(spark, sf_dir, "lineitem"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, features array<double>, label)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


# Orders as a tree with known membership: status is the first layer, priority the second.
# December orders are noise below the root; the lowest priority is noise below a status.
ORDER_TREE_SQL = """
tree_rows as (
  select o_orderkey as row_id, o_totalprice, o_custkey,
         case when month(o_orderdate) = 12 then -1
              when o_orderstatus = 'F' then 0 when o_orderstatus = 'O' then 1 else 2 end as c1,
         case when o_orderpriority = '5-LOW' then -1
              else cast(substr(o_orderpriority, 1, 1) as int) - 1 end as c2,
         extract(day from o_orderdate) as day_of_month,
         extract(year from o_orderdate) as order_year
  from orders),
membership as (
  select 'root' as node_id, row_id from tree_rows
  union all select 'root/' || c1, row_id from tree_rows where c1 >= 0
  union all select 'root/' || c1 || '/' || c2, row_id from tree_rows where c1 >= 0 and c2 >= 0)
"""


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        "o_totalprice",
        "o_custkey",
        F.when(F.month("o_orderdate") == 12, -1).when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("c1"),
        F.when(F.col("o_orderpriority") == "5-LOW", -1)
        .otherwise(F.substring("o_orderpriority", 1, 1).cast("int") - 1)
        .alias("c2"),
        F.dayofmonth("o_orderdate").alias("day_of_month"),
        F.year("o_orderdate").alias("order_year"),
    )


def order_membership(rows: DataFrame) -> DataFrame:
    """(node_id, row_id): every row under each of its ancestors, in one pass over the rows."""
    first = F.concat_ws("/", F.lit("root"), F.col("c1").cast("string"))
    second = F.concat_ws("/", first, F.col("c2").cast("string"))
    paths = F.array(
        F.lit("root"),
        F.when(F.col("c1") >= 0, first),
        F.when((F.col("c1") >= 0) & (F.col("c2") >= 0), second),
    )
    return rows.select(F.explode(F.array_compact(paths)).alias("node_id"), "row_id")


# Letters whose share separates the languages of the documents.
LETTERS = ["h", "é", "u", "z", "o", "w"]
LETTER_COLUMNS = [f"letter_{i}" for i in range(len(LETTERS))]


def _letter_sql(letter: str) -> str:
    return f"(length(text) - length(replace(text, '{letter}', ''))) * 100.0::double / length(text)"


LETTER_SQL = (
    "letters as (select doc_id as row_id, lang, source, n_chars, "
    + ", ".join(f"{_letter_sql(x)} as {c}" for x, c in zip(LETTERS, LETTER_COLUMNS))
    + ", ["
    + ", ".join(_letter_sql(x) for x in LETTERS)
    + "] as v from documents)"
)


def letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, lang, source, n_chars, letter shares per hundred characters) of every document; an empty text has no shares."""
    d = spread(table(spark, sf_dir, "documents"))
    size = F.length("text")
    share = lambda x: F.try_divide((size - F.length(F.replace(F.col("text"), F.lit(x), F.lit("")))) * F.lit(100.0), size.cast("double"))
    return d.select(
        F.col("doc_id").alias("row_id"), "lang", "source", "n_chars", *[share(x).alias(c) for x, c in zip(LETTERS, LETTER_COLUMNS)]
    )


def letter_points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The same as points of one node, in shares per hundred characters."""
    rows = letter_rows(spark, sf_dir)
    return rows.select(F.lit("root").alias("node_id"), "row_id", F.array(*LETTER_COLUMNS).alias("features"), *more)
