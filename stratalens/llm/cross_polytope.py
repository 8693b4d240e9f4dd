"""Nearest neighbours by inner product over cross-polytope hash tables.

Vectors are brought to the unit sphere: divided by the largest norm and lifted by one coordinate,
which keeps the order of inner products with any query (and does nothing where all norms are
equal). A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; blocks
of ``AXES`` rotated coordinates each name the nearest of ``2 * AXES`` signed axes, one hash table
per block. A query looks into the ``probes`` best axes of each table. Vectors of a bucket and the
queries that look into it meet in blocks of bounded size; only the best of a block leave it, with
exact inner products of the original vectors.

Equal vectors are hashed once and keep their smallest ids, as many as a result can hold. Queries
that found fewer than ``k`` neighbours are compared with every vector, in the same blocks.

Defined cases: vectors that are null, zero, of another length than most or hold null or
non-finite numbers take no part, nor do null ids; equal scores are ordered by id; of rows that
repeat an id and its vector one counts; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

AXES = 16
TABLES = 6
PROBES = 6
SEED = 20240607
#: Most vectors and queries of one block.
BLOCK = 4096
QUERY_BLOCK = 1024

FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _signs(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, size) * 2.0 - 1.0


def axis_values(x: np.ndarray, tables: int, axes: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """For each table, the inner products of unit rows with its signed axes."""
    size = max(axes, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    done, turn = 0, 0
    while done < tables:
        y = padded
        for k in range(3):
            y = hadamard(y * _signs(size, seed + 3 * turn + k))
        for b in range(min(size // axes, tables - done)):
            z = y[:, b * axes : (b + 1) * axes]
            yield np.concatenate([z, -z], axis=1)
            done += 1
        turn += 1


def lifted(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Rows divided by the largest norm with the coordinate that makes their length one; queries (None) by their own."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    if largest is None:
        return np.concatenate([x / norms, np.zeros_like(norms)], axis=1)
    y = x / largest
    return np.concatenate([y, np.sqrt(np.clip(1 - (norms / largest) ** 2, 0, None))], axis=1)


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = vectors[vector].cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(vectors[id_column].cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _hashed(df: DataFrame, kind: int, probes: int, tables: int, axes: int, largest: float | None) -> DataFrame:
    """(t, b, q, id, v): the buckets of every row, its ``probes`` best axes in each table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for t, values in enumerate(axis_values(lifted(x, largest), tables, axes)):
                best = values.argmax(1)[:, None] if probes == 1 else np.argpartition(-values, min(probes, values.shape[1] - 1), axis=1)[:, :probes]
                rows = np.repeat(np.arange(len(x)), best.shape[1])
                held = [pa.array(np.full(len(rows), t, np.int32)), pa.array(best.ravel().astype(np.int32)), pa.array(np.full(len(rows), kind, np.int32))]
                yield pa.RecordBatch.from_arrays([*held, batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], names=["t", "b", "q", "id", "v"])

    return df.select("id", "v").mapInArrow(hashed, "t int, b int, q int, id long, v array<double>")


def _met(rows: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of every query in every block of rows (t, b, q, id, v); q is 1 for queries.

    Where a bucket has more than a block of either kind, every block of vectors meets every
    block of queries, so no task holds more than one of each, however many share a bucket.
    """
    counts = rows.groupBy("t", "b").agg(F.sum(1 - F.col("q")).alias("n_v"), F.sum("q").alias("n_q")).where("n_v > 0 and n_q > 0")
    blocks = counts.select("t", "b", F.ceil(F.col("n_v") / BLOCK).cast("int").alias("bv"), F.ceil(F.col("n_q") / QUERY_BLOCK).cast("int").alias("bq"))
    own = F.when(F.col("q") == 1, F.pmod(F.xxhash64("id"), "bq")).otherwise(F.pmod(F.xxhash64("id"), "bv"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("q") == 1, F.col("bv")).otherwise(F.col("bq")) - 1))
    dealt = rows.join(blocks, ["t", "b"]).select("t", "b", "q", "id", "v", own.cast("int").alias("own"), other.alias("other"))
    i, j = F.when(F.col("q") == 1, F.col("other")).otherwise(F.col("own")), F.when(F.col("q") == 1, F.col("own")).otherwise(F.col("other"))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["q"].to_numpy() == 1
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        queries, base = np.stack(frame["v"][asks].to_numpy()), np.stack(frame["v"][~asks].to_numpy())
        q_ids, ids = frame["id"].to_numpy()[asks], frame["id"].to_numpy()[~asks]
        scores = queries @ base.T
        # One more than asked, as the query itself may be among them.
        keep = min(k + 1, len(ids))
        floor = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
        r, c = np.nonzero(scores >= floor[:, None])
        # Summed pair by pair, so that a pair scores the same in every block it meets in.
        exact = np.einsum("ij,ij->i", queries[r], base[c])
        # Equal scores beyond the last place: the smallest ids stay.
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        held = np.arange(len(r)) - np.searchsorted(r, r) < keep
        r, c, exact = r[held], c[held], exact[held]
        return pd.DataFrame({"query_id": q_ids[r], "vec_id": ids[c], "score": exact})

    return dealt.select("t", "b", i.alias("i"), j.alias("j"), "q", "id", "v").groupBy("t", "b", "i", "j").applyInPandas(best, FOUND)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, axes: int = AXES, probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` found for each row of ``queries``, itself left out."""
    base = usable(vectors, id_column, vector)
    asked = usable(queries, id_column, vector)
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m"))
    size = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not size:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    base, asked = base.where(F.size("v") == size[0].d), asked.where(F.size("v") == size[0].d).dropDuplicates(["id"])
    # Equal vectors are one entry with their smallest ids; a result needs at most k and the query itself.
    entries = stored(_copies(base, k).select(F.col("ids")[0].alias("id"), "v", "ids"))
    asked = stored(asked)
    found = _met(_hashed(entries, 0, 1, tables, axes, size[0].m).unionByName(_hashed(asked, 1, probes, tables, axes, None)), k).distinct()
    listed = entries.select(F.col("id").alias("vec_id"), "ids")
    ranked = stored(_ranked(found, listed, k))
    # Queries with fewer than k: every vector, in blocks.
    short = asked.join(ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    rest = stored(short)
    if rest.isEmpty() or entries.limit(1).isEmpty():
        return ranked
    one = lambda df, q: df.select(F.lit(0).alias("t"), F.lit(0).alias("b"), F.lit(q).alias("q"), "id", "v")
    exact = _ranked(_met(one(entries, 0).unionByName(one(rest, 1)), k), listed, k)
    return ranked.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact)


def _copies(base: DataFrame, k: int) -> DataFrame:
    """(ids, v): every different vector with its k + 1 smallest ids.

    Ids are first cut down within shares of a vector's copies, so that a vector with any number
    of copies is not gathered in one place.
    """
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    parts = base.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("share")).agg(smallest(F.collect_list("id")).alias("ids"))
    return parts.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))


def _ranked(found: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    """The k best of every query, with the ids of equal vectors written out."""
    slim = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(slim)).where(F.col("place") <= k + 1).drop("place")
    wide = best.join(listed, "vec_id").select("query_id", F.explode("ids").alias("vec_id"), "score").where(F.col("query_id") != F.col("vec_id"))
    return wide.withColumn("rank", F.row_number().over(slim)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
