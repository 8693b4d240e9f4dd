"""Nearest neighbours, ranks, distance summaries and label agreement within nodes.

Points are (node_id, row_id, features array<double>, ...). Ties in distance go to the lower
row id, and a row is never its own neighbour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hold
from .blocks import (
    BLOCK_ROWS, FEW, NODE, TILE_ROWS, WIDE, Guide, Reach, Squares, block_join, draw_pivots, finite_rows, guided_nearest, lengths, matrix, nearest_pairs, pair_distances, slices,
)
from .counting import count_nearer

_LIST = "node_id string, row_id bigint, neighbour bigint, dist double"


def in_one_node(df: DataFrame, vector: str = "features", *more: str) -> DataFrame:
    """Points of a table that is a single node."""
    return df.select(F.lit("root").alias(NODE), F.col("row_id").cast("bigint").alias("row_id"), F.col(vector).alias("features"), *more)


def _ordered(s: pd.DataFrame) -> pd.DataFrame:
    return s.sort_values("row_id", kind="stable").reset_index(drop=True)


def keep_nearest(lists: DataFrame, k: int | Column, by: tuple[str, ...] = (NODE, "row_id")) -> DataFrame:
    """The k nearest of partial lists, with their rank (1 is nearest); limited before the shuffle."""
    order = Window.partitionBy(*by).orderBy("dist", "neighbour")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, vector: str = "features", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, row_id, neighbour, dist, rank): the k nearest candidates of every query, exactly."""

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({"node_id": [], "row_id": [], "neighbour": [], "dist": []})
        s = _ordered(s)
        ids, mine = s["row_id"].to_numpy(), q["row_id"].to_numpy()
        rows, cols, d = nearest_pairs(matrix(q[vector]), matrix(s[vector]), mine, ids, k)
        return pd.DataFrame({"node_id": q[NODE].iloc[0], "row_id": mine[rows], "neighbour": ids[cols], "dist": d})

    guided, queries, candidates = _guided(queries, candidates, k, vector, block_rows)
    if queries is not None:
        found, _ = block_join(queries, candidates, block, _LIST, vector, Reach(k=k), block_rows, tiled=True)
        guided = found if guided is None else guided.unionByName(found)
    return keep_nearest(guided, k)


_PLACES = "node_id string, of string, row_id bigint, neighbour bigint, dist double"


def _outside(k: int, vector: str):
    """A block of queries with ``of`` and ``within`` beside candidates with ``sels``: the k nearest outside the selection ``of``."""

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = _ordered(s)
        ids, mine, x, y, within = s["row_id"].to_numpy(), q["row_id"].to_numpy(), matrix(q[vector]), matrix(s[vector]), q["within"].to_numpy()
        own: dict = {}
        for i, names in enumerate(s["sels"]):
            for name in names if names is not None else ():
                own.setdefault(name, []).append(i)
        parts = [pd.DataFrame({"node_id": [], "of": [], "row_id": [], "neighbour": [], "dist": []})]
        for name, at in q.groupby("of").indices.items():
            out = np.ones(len(s), dtype=bool)
            out[own.get(name, [])] = False
            left = np.flatnonzero(out)
            rows, cols, d = nearest_pairs(x[at], y[left], mine[at], ids[left], k, within[at])
            parts.append(pd.DataFrame({"node_id": [q[NODE].iloc[0]] * len(rows), "of": [name] * len(rows), "row_id": mine[at][rows], "neighbour": ids[left][cols], "dist": d}))
        return pd.concat([p for p in parts if len(p)] or parts)

    return block


def _cell_rows(k: int, block_rows: int) -> int:
    """Rows of a cell that a row has to search whole; a list of k must fit well into one."""
    return max(block_rows // WIDE, 4 * k)


def _guided(queries: DataFrame, candidates: DataFrame, k: int, vector: str, block_rows: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(lists of crowded nodes of few dimensions, queries and candidates of the other nodes)."""
    same = queries is candidates
    # They are read for sizes, cells and searches.
    queries = hold(queries)
    candidates = queries if same else hold(candidates)
    sizes = queries.groupBy(NODE).agg(F.count("*").alias("nq"), F.max(F.size(vector)).alias("width"))
    sizes = hold(sizes.withColumn("ns", F.col("nq")) if same else sizes.join(candidates.groupBy(NODE).agg(F.count("*").alias("ns")), NODE))
    width, crowded = sizes.agg(F.max("width"), F.count_if(F.greatest("nq", "ns") > block_rows)).head()
    if not crowded or (width or 0) >= FEW:
        return None, queries, candidates
    known = finite_rows(candidates, vector).withColumn("sels", F.array().cast("array<string>"))
    pivots = draw_pivots(known, sizes.where(F.greatest("nq", "ns") > block_rows), vector, _cell_rows(k, block_rows))
    if not pivots:
        return None, queries, candidates
    mine = F.col(NODE).isin(list(pivots))
    asking = finite_rows(queries.where(mine), vector).withColumn("of", F.lit(Guide.NONE))
    found = guided_nearest(asking, known.where(mine), k, _outside(k, vector), _PLACES, vector, pivots, block_rows)
    if found is None:
        return None, queries, candidates
    found = found.select(NODE, "row_id", "neighbour", "dist")
    left = sizes.where(~mine).limit(1).count()
    rest = queries.where(~mine) if left else None
    return found, rest, rest if same or not left else candidates.where(~mine)


def knn(points: DataFrame, k: int, vector: str = "features", block_rows: int = BLOCK_ROWS) -> DataFrame:
    narrow = points.select(NODE, "row_id", vector)
    return nearest(narrow, narrow, k, vector, block_rows)


def distance_profile(points: DataFrame, vector: str = "features", other: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distances of every row to all other rows of its node, reduced in the blocks.

    (node_id, row_id, n_others, sum, sum_sq, largest) and, with a second space, the sum of
    its squares and of the squared differences.
    """

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        hit = np.isin(q["row_id"].to_numpy(), s["row_id"].to_numpy())
        out = {c: np.zeros(len(q)) for c in ("sum", "sum_sq", "largest", "other_sum_sq", "diff_sq")}
        spaces = [(matrix(q[c]), matrix(s[c])) for c in ((vector, other) if other else (vector,))]
        squares = [Squares(*space) for space in spaces]
        for at in slices(len(q), TILE_ROWS):
            d, *more = [lengths(*space, known, at) for space, known in zip(spaces, squares)]
            out["sum"][at], out["largest"][at], out["sum_sq"][at] = d.sum(axis=1), d.max(axis=1), np.einsum("ij,ij->i", d, d)
            e = more[0] if more else np.zeros_like(d)
            out["other_sum_sq"][at] = np.einsum("ij,ij->i", e, e)
            d -= e
            out["diff_sq"][at] = np.einsum("ij,ij->i", d, d)
        return pd.DataFrame({"node_id": q[NODE].iloc[0], "row_id": q["row_id"], "n_others": len(s) - hit.astype("int64"), **out})

    schema = "node_id string, row_id bigint, n_others bigint, sum double, sum_sq double, largest double, other_sum_sq double, diff_sq double"
    narrow = points.select(NODE, "row_id", vector, *([other] if other else []))
    parts, whole = block_join(narrow, narrow, block, schema, vector, None, block_rows)
    if whole:
        return parts
    total = {c: F.sum(c).alias(c) for c in ("n_others", "sum", "sum_sq", "other_sum_sq", "diff_sq")}
    return parts.groupBy(NODE, "row_id").agg(*total.values(), F.max("largest").alias("largest"))


def stress(profile: DataFrame) -> DataFrame:
    """(node_id, n_points, stress): null where all rows of the node coincide."""
    sums = profile.groupBy(NODE).agg(F.count("*").alias("n_points"), F.sum("diff_sq").alias("x"), F.sum("sum_sq").alias("y"))
    return sums.select(NODE, "n_points", F.when(F.col("y") > 0, F.sqrt(F.col("x") / F.col("y"))).alias("stress"))


def two_space_neighbours(points: DataFrame, k: int, vector: str = "features", other: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, row_id, space, neighbour, dist, other_dist, rank): k nearest in both spaces.

    Space 0 is ``vector``, 1 is ``other``; ``other_dist`` is the distance of the same pair in
    the space that did not choose it.
    """

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = _ordered(s)
        ids, mine = s["row_id"].to_numpy(), q["row_id"].to_numpy()
        spaces = [(matrix(q[c]), matrix(s[c])) for c in (vector, other)]
        parts = []
        for i in (0, 1):
            rows, cols, d = nearest_pairs(*spaces[i], mine, ids, k)
            parts.append(
                pd.DataFrame(
                    {"node_id": q[NODE].iloc[0], "row_id": mine[rows], "space": i, "neighbour": ids[cols], "dist": d, "other_dist": pair_distances(*spaces[1 - i], rows, cols)}
                )
            )
        return pd.concat(parts)

    schema = "node_id string, row_id bigint, space int, neighbour bigint, dist double, other_dist double"
    narrow = points.select(NODE, "row_id", vector, other)
    lists, _ = block_join(narrow, narrow, block, schema, vector, None, block_rows)
    return keep_nearest(lists, k, (NODE, "row_id", "space"))


def cross_ranks(points: DataFrame, lists: DataFrame, vector: str = "features", other: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``other_rank`` to two-space lists: the neighbour's rank in the space that did not choose it.

    A rank is one plus the number of rows strictly nearer (ties by id), counted by cells of
    each space; no full ranking of a row is ever held.
    """
    lists, sides = hold(lists), []
    for space, column in ((1, vector), (0, other)):  # what one space chose is ranked in the other
        asked = lists.where(F.col("space") == space).select(NODE, "row_id", "neighbour", F.col("other_dist").alias("limit"))
        counts = count_nearer(points.select(NODE, "row_id", F.col(column).alias("features")), asked, block_rows)
        sides.append(counts.withColumn("space", F.lit(space)))
    ranked = lists.join(sides[0].unionByName(sides[1]), [NODE, "row_id", "space", "neighbour"])
    return ranked.withColumn("other_rank", F.col("nearer") + 1).drop("nearer")


def label_agreement(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(node_id, agreement): share of neighbours with the same label, averaged over rows."""
    mine = labels.select("row_id", F.col("label").alias("own"))
    theirs = labels.select(F.col("row_id").alias("neighbour"), F.col("label").alias("near"))
    same = lists.join(mine, "row_id").join(theirs, "neighbour").withColumn("same", (F.col("own") == F.col("near")).cast("double"))
    rows = same.groupBy(NODE, "row_id").agg(F.avg("same").alias("share"))
    return rows.groupBy(NODE).agg(F.avg("share").alias("agreement"), F.count("*").alias("n_points"))


def boundary_pool(points: DataFrame, selection: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(sel, row_id): rows outside a selection that are among the k nearest outsiders of some member.

    ``selection`` holds (sel, row_id). Rows are sent once for all selections, with the names of
    those they are in; a block leaves out a selection's own rows when it looks for its members.
    """
    points = hold(points.select(NODE, "row_id", "features"))
    member = points.drop(NODE).join(selection, "row_id").select(F.lit("root").alias(NODE), "row_id", "features", "sel")
    inside = selection.groupBy("row_id").agg(F.collect_set("sel").alias("sels"))
    every = points.join(inside, "row_id", "left").select(F.lit("root").alias(NODE), "row_id", "features", "sels")

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = _ordered(s)
        ids, mine, x, y = s["row_id"].to_numpy(), q["row_id"].to_numpy(), matrix(q["features"]), matrix(s["features"])
        own: dict = {}
        for i, names in enumerate(s["sels"]):
            for name in names if names is not None else ():
                own.setdefault(name, []).append(i)
        parts = []
        for name, at in q.groupby("sel", dropna=False).indices.items():
            name = None if pd.isna(name) else name
            out = np.ones(len(s), dtype=bool)
            out[own.get(name, [])] = False
            left = np.flatnonzero(out)
            rows, cols, d = nearest_pairs(x[at], y[left], mine[at], ids[left], k)
            parts.append(pd.DataFrame({"node_id": "root", "sel": [name] * len(rows), "row_id": mine[at][rows], "neighbour": ids[left][cols], "dist": d}))
        return pd.concat(parts)

    lists = _guided_outsiders(member, every, k, block_rows)
    if lists is None:
        found, _ = block_join(member, every, block, "node_id string, sel string, row_id bigint, neighbour bigint, dist double", "features", None, block_rows)
        lists = keep_nearest(found, k, ("sel", "row_id"))
    return lists.select("sel", F.col("neighbour").alias("row_id")).distinct()


def _guided_outsiders(member: DataFrame, every: DataFrame, k: int, block_rows: int) -> DataFrame | None:
    """(sel, row_id, neighbour, dist, rank) of members of few dimensions by the cells near them; None where blocks do as well."""
    sizes = hold(every.groupBy(NODE).agg(F.count("*").alias("nq"), F.count("*").alias("ns"), F.max(F.size("features")).alias("width")))
    width, n = sizes.agg(F.max("width"), F.max("nq")).head()
    if (n or 0) <= block_rows or (width or 0) >= FEW:
        return None
    # Names are told apart from no name, which leaves out nobody.
    known = finite_rows(every, "features").withColumn("sels", F.transform("sels", lambda x: F.concat(F.lit("="), x)))
    asking = finite_rows(member, "features").withColumn("of", F.coalesce(F.concat(F.lit("="), "sel"), F.lit(Guide.NONE))).drop("sel")
    pivots = draw_pivots(known, sizes, "features", _cell_rows(k, block_rows))
    found = guided_nearest(asking, known, k, _outside(k, "features"), _PLACES, "features", pivots, block_rows) if pivots else None
    if found is None:
        return None
    name = F.when(F.col("of") != Guide.NONE, F.substring("of", 2, 1 << 30)).alias("sel")
    return keep_nearest(found, k, ("of", "row_id")).select(name, "row_id", "neighbour", "dist", "rank")


def silhouette(points: DataFrame, label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, silhouette, n_points) with Euclidean distances over non-noise rows.

    Null with fewer than three rows or two clusters; a row alone in its cluster scores 0.
    """
    kept = points.where(F.col(label) >= 0).select(NODE, "row_id", "features", F.col(label).cast("int").alias("label"))

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        x, y = matrix(q["features"]), matrix(s["features"])
        classes, of = np.unique(s["label"].to_numpy(), return_inverse=True)
        member, squares = np.eye(len(classes))[of], Squares(x, y)
        sums = np.concatenate([lengths(x, y, squares, at) @ member for at in slices(len(q), TILE_ROWS)])
        size = np.bincount(of, minlength=len(classes))
        n, m = len(q), len(classes)
        return pd.DataFrame(
            {
                "node_id": q[NODE].iloc[0], "row_id": np.repeat(q["row_id"].to_numpy(), m), "own": np.repeat(q["label"].to_numpy(), m),
                "cluster": np.tile(classes, n), "total": sums.ravel(), "n": np.tile(size, n),
            }
        )

    schema = "node_id string, row_id bigint, own int, cluster int, total double, n bigint"
    parts, _ = block_join(kept, kept, block, schema, "features", None, block_rows)
    per = parts.groupBy(NODE, "row_id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mine = F.col("cluster") == F.col("own")
    rows = per.groupBy(NODE, "row_id").agg(
        F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
    )
    high = F.greatest("a", "b")
    score = F.when(F.col("a").isNull(), 0.0).when(high > 0, (F.col("b") - F.col("a")) / high).otherwise(0.0)
    out = rows.groupBy(NODE).agg(F.avg(score).alias("s"), F.count("*").alias("n_points"), F.count("b").alias("n_b"))
    return out.select(NODE, F.when((F.col("n_points") >= 3) & (F.col("n_b") > 0), F.col("s")).alias("silhouette"), "n_points")
