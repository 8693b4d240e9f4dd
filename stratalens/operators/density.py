"""Density clustering of the rows of every node at once: fixed radius and hierarchical.

Points are (node_id, row_id, features). Labels are numbered per node by the smallest row id
of the cluster; noise is -1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, hold
from ..functions.ranks import running_total
from .blocks import BLOCK_ROWS, NODE, TILE_ROWS, Reach, Squares, block_join, distances, finite_rows, lengths, matrix, placed_rows, slices
from .graphs import components, relabel, to_roots
from .neighbours import knn

# The row itself is not counted among its min_samples neighbours.
SELF_COUNTS = False
# Neighbours of a row that the spanning tree of a large node starts with.
SEEDS = 16
# Merges between clusters of a node that one task orders; see ``_cluster_tree``.
SKELETON_ROWS = 2_000_000


def _numbered(clusters: DataFrame, name: str) -> DataFrame:
    """(node_id, name, label): clusters numbered per node by their smallest row."""
    firsts = clusters.groupBy(NODE, name).agg(F.min("row_id").alias("first"))
    return firsts.select(NODE, name, (F.row_number().over(Window.partitionBy(NODE).orderBy("first")) - 1).alias("label"))


def _with_labels(rows: DataFrame, clustered: DataFrame, name: str) -> DataFrame:
    found = clustered.join(_numbered(clustered, name), [NODE, name]).select(NODE, "row_id", "label")
    return rows.select(NODE, "row_id").join(found, [NODE, "row_id"], "left").select(NODE, "row_id", F.coalesce("label", F.lit(-1)).alias("label"))


# ---- fixed radius -------------------------------------------------------------------------


def _block_components(adjacent: np.ndarray) -> np.ndarray:
    """Component number of every vertex of a symmetric adjacency matrix."""
    left = np.ones(len(adjacent), dtype=bool)
    out = np.full(len(adjacent), -1)
    for start in range(len(adjacent)):
        if not left[start]:
            continue
        front = np.array([start])
        left[start] = False
        while len(front):
            out[front] = start
            new = adjacent[front].any(axis=0) & left
            left &= ~new
            front = np.nonzero(new)[0]
    return out


def dbscan(points: DataFrame, eps: float, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, row_id, label). A core row has ``min_samples`` rows within ``eps``, itself included.

    Blocks hand on counts, then one link per core row to its block-local component, then one
    candidate label per border row; pairs of rows are never listed. Border rows take the
    lowest cluster in reach.
    """
    narrow = cut_lineage(points.select(NODE, "row_id", "features"))
    reach = Reach(radius=eps)

    def count(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        near = distances(matrix(q["features"]), matrix(s["features"])) <= eps
        return pd.DataFrame({"node_id": q[NODE], "row_id": q["row_id"], "n": near.sum(axis=1)})

    counts, _ = block_join(narrow, narrow, count, "node_id string, row_id bigint, n bigint", "features", reach, block_rows)
    dense = hold(counts.groupBy(NODE, "row_id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select(NODE, "row_id"))
    core = narrow.join(dense, [NODE, "row_id"])

    def link(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([q["row_id"], s["row_id"]]))
        i, j = np.nonzero(distances(matrix(q["features"]), matrix(s["features"])) <= eps)
        a, b = np.searchsorted(ids, q["row_id"].to_numpy()[i]), np.searchsorted(ids, s["row_id"].to_numpy()[j])
        adjacent = np.zeros((len(ids), len(ids)), dtype=bool)
        adjacent[a, b] = adjacent[b, a] = True
        return pd.DataFrame({"node_id": q[NODE].iloc[0] if len(q) else "", "a": ids, "b": ids[_block_components(adjacent)]})

    links, _ = block_join(core, core, link, "node_id string, a bigint, b bigint", "features", reach, block_rows, once=True)
    found = hold(components(dense.withColumnRenamed("row_id", "v"), links))
    number = _numbered(found.withColumnRenamed("v", "row_id"), "c")
    cores = hold(found.join(number, [NODE, "c"]).select(NODE, F.col("v").alias("row_id"), "label"))

    def border(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        near = distances(matrix(q["features"]), matrix(s["features"])) <= eps
        label = np.where(near, s["label"].to_numpy()[None, :], np.iinfo("int32").max).min(axis=1) if len(s) else np.full(len(q), np.iinfo("int32").max)
        keep = label < np.iinfo("int32").max
        return pd.DataFrame({"node_id": q[NODE][keep], "row_id": q["row_id"][keep], "label": label[keep]})

    rest = narrow.join(dense, [NODE, "row_id"], "left_anti")
    touched, _ = block_join(rest, core.join(cores, [NODE, "row_id"]), border, "node_id string, row_id bigint, label int", "features", reach, block_rows)
    edge = touched.groupBy(NODE, "row_id").agg(F.min("label").alias("label"))
    placed = cores.unionByName(edge)
    return narrow.select(NODE, "row_id").join(placed, [NODE, "row_id"], "left").select(NODE, "row_id", F.coalesce("label", F.lit(-1)).alias("label"))


# ---- hierarchical -------------------------------------------------------------------------


def core_distances(points: DataFrame, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, row_id, core): distance to the ``min_samples``-th neighbour, or the last one of a small node."""
    lists = knn(points, min_samples - 1 if SELF_COUNTS else min_samples, block_rows=block_rows)
    return lists.groupBy(NODE, "row_id").agg(F.max("dist").alias("core"))


def _local_tree(weight: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of one block's dense weights, grown vertex by vertex.

    Equal weights are ordered by the ids of their ends, here and in the joins that merge
    blocks, so there is one tree however the rows are cut.
    """
    n = len(weight)
    best, source, left = weight[0].copy(), np.zeros(n, dtype=int), np.ones(n, dtype=bool)
    low, high = np.minimum(ids[0], ids), np.maximum(ids[0], ids)
    left[0] = False
    a, b, w = np.empty(n - 1, int), np.empty(n - 1, int), np.empty(n - 1)
    for step in range(n - 1):
        open_best = np.where(left, best, np.inf)
        tied = np.nonzero((open_best == open_best.min()) & left)[0]
        at = tied[np.lexsort((high[tied], low[tied]))[0]] if len(tied) > 1 else tied[0]
        a[step], b[step], w[step] = source[at], at, best[at]
        left[at] = False
        lo, hi = np.minimum(ids[at], ids), np.maximum(ids[at], ids)
        earlier = (lo < low) | ((lo == low) & (hi < high))
        closer = left & ((weight[at] < best) | ((weight[at] == best) & earlier))
        best[closer], source[closer], low[closer], high[closer] = weight[at][closer], at, lo[closer], hi[closer]
    return a, b, w


def _block_tree(rows: DataFrame) -> DataFrame:
    """Trees of nodes that fit one block."""

    def block(q: pd.DataFrame) -> pd.DataFrame:
        ids, x, core = q["row_id"].to_numpy(), matrix(q["features"]), q["core"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"node_id": pd.Series(dtype=object), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "w": pd.Series(dtype=float)})
        a, b, w = _local_tree(np.maximum(distances(x, x), np.maximum(core[:, None], core[None, :])), ids)
        return pd.DataFrame({"node_id": q[NODE].iloc[0], "a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "w": w})

    return rows.groupBy(NODE).applyInPandas(block, _EDGE)


_EDGE = "node_id string, a bigint, b bigint, w double"


def _nearest_foreign(asking: DataFrame, rows: DataFrame, pivots: dict, block_rows: int) -> DataFrame:
    """(node_id, row_id, w, a, b): the lightest edge of every asking row to another component, if not heavier than its ``limit``."""

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("row_id", kind="stable")
        ids, mine = s["row_id"].to_numpy(), q["row_id"].to_numpy()
        w = np.maximum(distances(matrix(q["features"]), matrix(s["features"])), np.maximum(q["core"].to_numpy()[:, None], s["core"].to_numpy()[None, :]))
        w[q["c"].to_numpy()[:, None] == s["c"].to_numpy()[None, :]] = np.inf
        # Of equal edges of a row the one to the smallest id comes first.
        at = w.argmin(axis=1)
        best = w[np.arange(len(w)), at]
        keep = np.isfinite(best) & (best <= q["limit"].to_numpy())
        x, y = mine[keep], ids[at[keep]]
        return pd.DataFrame({"node_id": q[NODE][keep], "row_id": x, "w": best[keep], "a": np.minimum(x, y), "b": np.maximum(x, y)})

    schema = "node_id string, row_id bigint, w double, a bigint, b bigint"
    found, _ = block_join(asking, rows, block, schema, "features", Reach(column="limit", foreign="c"), block_rows, pivots=pivots)
    best = found.groupBy(NODE, "row_id").agg(F.min(F.struct("w", "a", "b")).alias("e"))
    return hold(best.select(NODE, "row_id", "e.w", "e.a", "e.b"))


def _component_rounds(rows: DataFrame, lists: DataFrame, block_rows: int) -> DataFrame:
    """Trees of nodes of many blocks: every component asks for its lightest way out, round by round.

    Known edges, at first those to the nearest neighbours, bound from above what a component has to pay;
    ``least`` bounds from below what an edge of a row that was not seen yet weighs. Only rows whose
    lower bound does not exceed the bound of their component search, within it, and
    what they find or miss becomes their new bounds. So the edges held are a few per row, rounds at
    least halve the components, and searches are cut by cells that are too far or of one component.
    """
    far = lists.groupBy(NODE, "row_id").agg(F.max("dist").alias("far"))
    placed, pivots = placed_rows(rows, block_rows=block_rows)
    state = hold(rows.join(far, [NODE, "row_id"]).select(NODE, "row_id", F.col("row_id").alias("c"), F.greatest("core", "far").alias("least")))
    core = lambda c: rows.select(NODE, F.col("row_id").alias(c), F.col("core").alias(f"core_{c}"))
    pool = lists.select(NODE, F.least("row_id", "neighbour").alias("a"), F.greatest("row_id", "neighbour").alias("b"), "dist").distinct()
    pool = pool.join(core("a"), [NODE, "a"]).join(core("b"), [NODE, "b"]).select(NODE, F.greatest("dist", "core_a", "core_b").alias("w"), "a", "b")
    pool = hold(pool.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")))
    kept = None
    while True:
        counts = state.groupBy(NODE, "c").agg(F.min("row_id").alias("first"))
        several = counts.groupBy(NODE).agg(F.count("*").alias("n")).where("n > 1").select(NODE)
        groups = counts.join(several, NODE)
        bounds = hold(groups.join(_lightest(pool), [NODE, "c"], "left"))
        live, lost = bounds.agg(F.count("*"), F.count_if(F.col("e").isNull())).head()
        if not live:
            return hold(kept)
        if lost:
            # A component that no known edge leaves asks for one from its first row.
            ask = bounds.where(F.col("e").isNull()).select(NODE, "c", F.col("first").alias("row_id"), F.lit(float("inf")).alias("limit"))
            more = _nearest_foreign(placed.join(ask, [NODE, "row_id"]), placed.join(state.select(NODE, "row_id", "c"), [NODE, "row_id"]), pivots, block_rows)
            pool = hold(pool.unionByName(_with_ends(more, state)))
            bounds = hold(groups.join(_lightest(pool), [NODE, "c"], "left"))
        open_rows = hold(state.join(bounds.select(NODE, "c", F.col("e.w").alias("limit")), [NODE, "c"]).where(F.col("least") <= F.col("limit")))
        found = _nearest_foreign(
            placed.join(open_rows.select(NODE, "row_id", "c", "limit"), [NODE, "row_id"]), placed.join(state.select(NODE, "row_id", "c"), [NODE, "row_id"]), pivots, block_rows
        )
        pool = pool.unionByName(_with_ends(found, state))
        best = hold(_lightest(pool).select(NODE, "c", "to", "e.w", "e.a", "e.b"))
        picked = best.select(NODE, "a", "b", "w").distinct()
        kept = picked if kept is None else kept.unionByName(picked)
        back = best.select(NODE, F.col("c").alias("to"), F.col("to").alias("back"))
        first = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to"))
        parent = to_roots(best.join(back, [NODE, "to"], "left").select(NODE, "c", first.alias("p")))
        pool = hold(relabel(pool, parent, "ca", "cb").where(F.col("ca") != F.col("cb")).select(NODE, "w", "a", "b", "ca", "cb"))
        told = open_rows.select(NODE, "row_id", "limit").join(found.select(NODE, "row_id", "w"), [NODE, "row_id"], "left")
        told = told.select(NODE, "row_id", F.coalesce("w", "limit").alias("new"))
        state = relabel(state, parent, "c").join(told, [NODE, "row_id"], "left")
        state = hold(state.select(NODE, "row_id", "c", F.coalesce(F.greatest("least", "new"), "least").alias("least")))


def _with_ends(found: DataFrame, state: DataFrame) -> DataFrame:
    """Edges with the components of their ends."""
    end = lambda c: state.select(NODE, F.col("row_id").alias(c), F.col("c").alias(f"c{c}"))
    return found.select(NODE, "w", "a", "b").distinct().join(end("a"), [NODE, "a"]).join(end("b"), [NODE, "b"]).select(NODE, "w", "a", "b", "ca", "cb")


def _lightest(pool: DataFrame) -> DataFrame:
    """(node_id, c, e, to): the lightest known edge out of every component, ties by the ids of its ends."""
    e = F.struct("w", "a", "b").alias("e")
    both = pool.select(NODE, F.col("ca").alias("c"), e, F.col("cb").alias("to")).unionByName(pool.select(NODE, F.col("cb").alias("c"), e, F.col("ca").alias("to")))
    return both.groupBy(NODE, "c").agg(F.min("e").alias("e"), F.min_by("to", "e").alias("to"))


def mutual_spanning_tree(points: DataFrame, min_samples: int, block_rows: int = BLOCK_ROWS, apart: str | None = None) -> DataFrame:
    """(node_id, a, b, w): minimum spanning tree under mutual reachability distance.

    A node that fits one block is solved by one task; others are by rounds of
    components (``_component_rounds``), which never list all pairs or a tree per pair of blocks.
    Equal weights are ordered by the ids of their ends, so both give the same tree.
    """
    sizes = hold(points.groupBy(NODE).agg(F.count("*").alias("n_rows")))
    large = sizes.where(F.col("n_rows") > block_rows).select(NODE)
    crowded = not large.isEmpty()
    lists = None
    if apart is None:
        lists = hold(knn(points, max(min_samples, SEEDS) if crowded else min_samples, block_rows=block_rows))
        core = lists.where(F.col("rank") <= min_samples).groupBy(NODE, "row_id").agg(F.max("dist").alias("core"))
        # A row alone in its node has no neighbour, and no edge.
        rows = points.select(NODE, "row_id", "features").join(core, [NODE, "row_id"])
    else:
        rows = points.select(NODE, "row_id", "features", F.col(apart).alias("core"))
    rows = hold(rows)
    small = _block_tree(rows.join(large, NODE, "left_anti"))
    if not crowded:
        return hold(small)
    if lists is None:
        lists = hold(knn(rows.join(large, NODE, "left_semi"), SEEDS, block_rows=block_rows))
    grown = _component_rounds(rows.join(large, NODE, "left_semi"), lists.join(large, NODE, "left_semi"), block_rows)
    return hold(small.unionByName(grown))


def _grow_clusters(rows: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((node_id, row_id, seed, w), (node_id, x, y, w)): when each row joins a group of ``least`` rows.

    A small group leaves by its lightest edge, so these choices form trees whose weights
    fall towards the root. A tree rooted in a grown group is taken up by it, each group at
    the weight of its own edge. A tree rooted in two small groups that chose each other
    grows in the order of its weights: if it reaches ``least`` rows before the lightest edge
    out of the tree, a group is born there; otherwise everything lighter than that edge is
    one small group for the next round. Trees at least halve, so rounds are logarithmic. What
    is left are the edges between grown groups, at most one per ``least`` rows.
    """
    edges = hold(tree.select(NODE, F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").alias("e"), F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")))
    waiting = rows.select(NODE, "row_id", F.col("row_id").alias("c"))
    joined = None
    while True:
        out = edges.select(NODE, F.col("ca").alias("c"), F.col("na").alias("n"), F.struct("e", F.col("cb").alias("to"), F.col("nb").alias("n_to")).alias("x")).unionByName(
            edges.select(NODE, F.col("cb").alias("c"), F.col("nb").alias("n"), F.struct("e", F.col("ca").alias("to"), F.col("na").alias("n_to")).alias("x"))
        )
        best = out.where(F.col("n") < least).groupBy(NODE, "c").agg(F.max("n").alias("n"), F.min("x").alias("x"))
        best = hold(best.select(NODE, "c", "n", "x.e", "x.to", "x.n_to"))
        if not best.limit(1).count():
            break
        back = best.select(NODE, F.col("c").alias("to"), F.col("e").alias("e2"))
        aimed = best.join(back, [NODE, "to"], "left").withColumn("mutual", F.coalesce(F.col("e") == F.col("e2"), F.lit(False)))
        roots = to_roots(aimed.select(NODE, "c", F.when(F.col("mutual") & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")))
        small = roots.where(F.col("c") == F.col("p")).select(NODE, "p", F.lit(True).alias("small"))
        member = hold(best.select(NODE, "c", "n", "e").join(roots, [NODE, "c"]).join(small, [NODE, "p"], "left").withColumn("small", F.coalesce("small", F.lit(False))))

        # The lightest edge out of every tree.
        here = relabel(edges.select(NODE, "ca", "cb", "e"), roots, "ca", "cb").where(F.col("ca") != F.col("cb"))
        exits = here.select(NODE, F.col("ca").alias("p"), "e").unionByName(here.select(NODE, F.col("cb").alias("p"), "e")).groupBy(NODE, "p").agg(F.min("e").alias("exit"))
        # Where a tree reaches the size: its lightest ``least`` groups are enough to tell.
        key = F.when(F.col("c") != F.col("p"), F.col("e"))
        order = Window.partitionBy(NODE, "p").orderBy(F.col("key").asc_nulls_first())
        listed = member.where("small").withColumn("key", key)
        first = listed.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= least)
        born = first.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") >= least).groupBy(NODE, "p").agg(F.min("key").alias("born"))
        judged = listed.join(exits, [NODE, "p"], "left").join(born, [NODE, "p"], "left")
        alive = F.col("born").isNotNull() & (F.col("exit").isNull() | (F.col("born") < F.col("exit")))
        early = F.col("key").isNull() | (F.col("key") <= F.col("born"))
        lighter = F.col("key").isNull() | F.col("exit").isNull() | (F.col("key") < F.col("exit"))
        grown = judged.where(alive).select(NODE, "c", "p", F.lit(least).cast("bigint").alias("n"), F.when(early, F.col("born.w")).otherwise(F.col("key.w")).alias("w"))
        merged = (
            judged.where(~F.coalesce(alive, F.lit(False)) & lighter)
            .withColumn("n", F.sum("n").over(Window.partitionBy(NODE, "p")))
            .select(NODE, "c", "p", "n", F.lit(None).cast("double").alias("w"))
        )
        taken = member.where("not small").select(NODE, "c", "p", F.lit(least).cast("bigint").alias("n"), F.col("e.w").alias("w"))
        fate = hold(taken.unionByName(grown).unionByName(merged))

        side = lambda c: fate.select(NODE, F.col("c").alias(c), F.col("p").alias(f"p_{c}"), F.col("n").alias(f"n_{c}"))
        moved = edges.join(side("ca"), [NODE, "ca"], "left").join(side("cb"), [NODE, "cb"], "left").select(
            NODE, F.coalesce("p_ca", "ca").alias("ca"), F.coalesce("p_cb", "cb").alias("cb"), "e",
            F.coalesce("n_ca", "na").alias("na"), F.coalesce("n_cb", "nb").alias("nb"),
        )
        edges = hold(moved.where(F.col("ca") != F.col("cb")))
        stepped = waiting.join(fate, [NODE, "c"], "left")
        stepped = hold(stepped.select(NODE, "row_id", F.coalesce("p", "c").alias("c"), (F.coalesce("n", F.lit(0)) >= least).alias("in"), "w"))
        done = stepped.where("in").select(NODE, "row_id", F.col("c").alias("seed"), "w")
        joined = done if joined is None else joined.unionByName(done)
        waiting = stepped.where(~F.col("in")).select(NODE, "row_id", "c")
    if joined is None:
        joined = rows.select(NODE, "row_id", F.col("row_id").alias("seed"), F.lit(0.0).alias("w")).limit(0)
    return hold(joined), edges.select(NODE, F.col("ca").alias("x"), F.col("cb").alias("y"), "e.w", "e.a", "e.b")


_CLUSTER_SCHEMA = "node_id string, cluster bigint, parent bigint, w_end double"


def _merge_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one node from its merges, lightest first; merged clusters get ids -1, -2, ..."""
    node, up, top, rows = pdf[NODE].iloc[0], {}, {}, []

    def root(v):
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    merges = pdf[pdf["y"].notna()].sort_values(["w", "a", "b"])
    for i, (x, y, w) in enumerate(zip(merges["x"], merges["y"], merges["w"])):
        rx, ry = root(int(x)), root(int(y))
        for r in (rx, ry):
            rows.append((node, top.get(r, r), -(i + 1), w))
        up[ry] = rx
        top[rx] = -(i + 1)
    last = -len(merges) if len(merges) else int(pdf["x"].iloc[0])
    rows.append((node, last, None, np.nan))
    out = pd.DataFrame(rows, columns=["node_id", "cluster", "parent", "w_end"])
    out["parent"] = out["parent"].astype("Int64")
    return out


def _cluster_tree(joined: DataFrame, skeleton: DataFrame) -> DataFrame:
    """(node_id, cluster, parent, w_end): the binary tree of grown groups, ``w_end`` the weight of its merge.

    Only merges between grown groups are ordered here: three numbers each, at most one per
    ``min_cluster_size`` rows. Up to ``SKELETON_ROWS`` merges per node go to one task; more
    are resolved by ``merge_rounds``.
    """
    seeds = joined.groupBy(NODE, F.col("seed").alias("x")).agg(F.lit(None).cast("bigint").alias("y"))
    rows = hold(skeleton.select(NODE, "x", "y", "w", "a", "b").unionByName(seeds.select(NODE, "x", "y", F.lit(None).cast("double").alias("w"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))))
    if _most_rows(rows) <= SKELETON_ROWS:
        return hold(rows.groupBy(NODE).applyInPandas(_merge_order, _CLUSTER_SCHEMA))
    return merge_rounds(rows.where(F.col("y").isNotNull()), seeds.select(NODE, "x"))


def _most_rows(df: DataFrame) -> int:
    return df.groupBy(NODE).count().agg(F.max("count")).head()[0] or 0


def merge_rounds(merges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same tree in logarithmic rounds, without a whole tree in one task.

    Going down, every group names its lightest merge; the named ones are set aside and what they
    connect becomes one group, so that at most half of the merges go on. Going up again, the
    tree of the merges that went on is known, and one that was set aside belongs on the way
    from its group to the root, below the first heavier merge: such merges of one gap
    are a chain in the order of their weights. A merged cluster is named by a negative hash of the
    two rows of its edge.
    """
    e = F.struct("w", "a", "b")
    live = hold(merges.select(NODE, (-F.abs(F.xxhash64("a", "b")) - 1).alias("m"), e.alias("e"), F.col("x").alias("ca"), F.col("y").alias("cb")))
    levels = []
    while not live.isEmpty():
        side = lambda x, y: live.select(NODE, F.col(x).alias("c"), F.struct("e", "m", F.col(y).alias("to")).alias("x"))  # noqa: B023, E731
        best = side("ca", "cb").unionByName(side("cb", "ca")).groupBy(NODE, "c").agg(F.min("x").alias("x"))
        best = hold(best.select(NODE, "c", "x.e", "x.m", "x.to"))
        back = best.select(NODE, F.col("c").alias("to"), F.col("to").alias("back"))
        first = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to"))
        roots = to_roots(best.join(back, [NODE, "to"], "left").select(NODE, "c", first.alias("p")))
        aside = hold(best.join(roots, [NODE, "c"]).select(NODE, "m", "e", F.col("p").alias("s")).distinct())
        levels.append((best, aside))
        live = hold(relabel(live.join(aside.select(NODE, "m"), [NODE, "m"], "left_anti"), roots, "ca", "cb").select(NODE, "m", "e", "ca", "cb"))
    names = seeds.select(NODE, F.col("x").alias("cluster"))
    if not levels:
        return hold(names.select(NODE, "cluster", F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("double").alias("w_end")))
    # (node_id, m, e, up, e_up): the tree of the merges of all levels above.
    tree, above = None, None
    for best, aside in reversed(levels):
        tree = _with_chains(tree, above, aside)
        above = best
    leaves = names.join(above.select(NODE, F.col("c").alias("cluster"), F.col("m").alias("parent"), F.col("e.w").alias("w_end")), [NODE, "cluster"], "left")
    return hold(leaves.unionByName(tree.select(NODE, F.col("m").alias("cluster"), F.col("up").alias("parent"), F.col("e_up.w").alias("w_end"))))


def _with_chains(tree: DataFrame | None, above: DataFrame | None, aside: DataFrame) -> DataFrame:
    """``tree`` with the merges of one more level; ``above`` names the first merge of every group that went on."""
    none = lambda like: F.lit(None).cast(dict(aside.dtypes)[like])
    if tree is None:
        gaps = aside.select(NODE, "m", "e", F.lit(False).alias("climbed"), F.col("s").alias("gap"), none("m").alias("below"), none("m").alias("up"), none("e").alias("e_up"))
    else:
        start = above.select(NODE, F.col("c").alias("s"), F.col("m").alias("up"), F.col("e").alias("e_up"))
        at = aside.join(start, [NODE, "s"], "left").withColumn("below", F.when(F.col("e_up") < F.col("e"), F.col("up")))
        jump, jumps = tree.where(F.col("up").isNotNull()).select(NODE, F.col("m").alias("below"), F.col("up").alias("to"), F.col("e_up").alias("far")), []
        while not (jump := hold(jump)).isEmpty():
            jumps.append(jump)
            onward = jump.select(NODE, F.col("below").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
            jump = jump.join(onward, [NODE, "to"]).select(NODE, "below", F.col("to2").alias("to"), F.col("far2").alias("far"))
        for jump in reversed(jumps):
            at = at.join(jump, [NODE, "below"], "left").withColumn("below", F.when(F.col("far") < F.col("e"), F.col("to")).otherwise(F.col("below"))).drop("to", "far")
        over = tree.select(NODE, F.col("m").alias("below"), F.col("up").alias("up2"), F.col("e_up").alias("e_up2"))
        at = at.join(over, [NODE, "below"], "left")
        climbed = F.col("below").isNotNull()
        gaps = at.select(
            NODE, "m", "e", climbed.alias("climbed"), F.coalesce("below", "s").alias("gap"), "below",
            F.when(climbed, F.col("up2")).otherwise(F.col("up")).alias("up"), F.when(climbed, F.col("e_up2")).otherwise(F.col("e_up")).alias("e_up"),
        )
    placed = hold(running_total(gaps.withColumn("one", F.lit(1)), [NODE, "climbed", "gap"], "e", "one", "turn"))
    following = placed.select(NODE, "climbed", "gap", (F.col("turn") - 1).alias("turn"), F.col("m").alias("next"), F.col("e").alias("e_next"))
    chained = placed.join(following, [NODE, "climbed", "gap", "turn"], "left")
    chained = chained.select(NODE, "m", "e", F.coalesce("next", "up").alias("up"), F.coalesce("e_next", "e_up").alias("e_up"))
    if tree is None:
        return hold(chained)
    firsts = placed.where((F.col("turn") == 1) & F.col("below").isNotNull()).select(NODE, F.col("below").alias("m"), F.col("m").alias("first"), F.col("e").alias("e_first"))
    lifted = tree.join(firsts, [NODE, "m"], "left").select(NODE, "m", "e", F.coalesce("first", "up").alias("up"), F.coalesce("e_first", "e_up").alias("e_up"))
    return hold(lifted.unionByName(chained))


def _place_rows(joined: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node_id, row_id, cluster, w): the cluster a row joined, climbing from its seed while that had merged before.

    Jumps of one, two, four, ... clusters upwards are made by doubling; a row then takes the
    longest jumps first, each while even its last cluster had merged before. Rounds are
    logarithmic in the depth of the tree.
    """
    jump = clusters.where(F.col("parent").isNotNull()).select(NODE, "cluster", F.col("parent").alias("up"), F.col("w_end").alias("far"))
    jumps = []
    while not (jump := hold(jump)).isEmpty():
        jumps.append(jump)
        above = jump.select(NODE, F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        jump = jump.join(above, [NODE, "up"]).select(NODE, "cluster", F.col("up2").alias("up"), F.greatest("far", "far2").alias("far"))
    rows = joined.select(NODE, "row_id", F.col("seed").alias("cluster"), "w")
    for jump in reversed(jumps):
        rows = rows.join(jump, [NODE, "cluster"], "left").select(NODE, "row_id", F.when(F.col("w") > F.col("far"), F.col("up")).otherwise(F.col("cluster")).alias("cluster"), "w")
    return rows


def _stabilities(placed: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters with their own rows' density sums; density is one over the joining weight."""
    density = F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(float("inf"))
    own = placed.withColumn("d", density).groupBy(NODE, "cluster").agg(F.count("*").alias("n_own"), F.sum("d").alias("d_sum"), F.max("d").alias("d_max"))
    return clusters.join(own, [NODE, "cluster"], "left")


def _select(pdf: pd.DataFrame) -> pd.DataFrame:
    """Excess of mass on one node's cluster tree: keep a cluster unless its parts are jointly steadier."""
    node = pdf[NODE].iloc[0]
    kids: dict[int, list[int]] = {}
    info = {}
    for r in pdf.itertuples():
        info[r.cluster] = r
        if not pd.isna(r.parent):
            kids.setdefault(int(r.parent), []).append(r.cluster)
    top = next(c for c, r in info.items() if pd.isna(r.parent))
    order, stack = [], [top]
    while stack:
        c = stack.pop()
        order.append(c)
        stack.extend(kids.get(c, []))
    size, score, peak, keep = {}, {}, {}, {}
    for c in reversed(order):
        r, below = info[c], kids.get(c, [])
        n_own, d_sum = (0, 0.0) if pd.isna(r.n_own) else (r.n_own, r.d_sum)
        size[c] = n_own + sum(size[k] for k in below)
        birth = 0.0 if pd.isna(r.w_end) else (1 / r.w_end if r.w_end > 0 else np.inf)
        split = [1 / info[k].w_end if info[k].w_end > 0 else np.inf for k in below]
        mass = (d_sum - n_own * birth if n_own else 0.0) + sum(size[k] * (s - birth) for k, s in zip(below, split))
        mass = 0.0 if np.isnan(mass) else mass
        peak[c] = max([0.0 if pd.isna(r.d_max) else r.d_max, *split, *(peak[k] for k in below)])
        parts = sum(score[k] for k in below)
        keep[c] = c != top and (not below or mass >= parts)
        score[c] = mass if keep[c] else parts
    chosen = {}
    for c in order:
        over = chosen.get(int(info[c].parent)) if not pd.isna(info[c].parent) else None
        chosen[c] = over if over is not None else (c if keep[c] else None)
    return pd.DataFrame(
        {"node_id": node, "cluster": order, "selected": pd.array([chosen[c] for c in order], dtype="Int64"), "peak": [peak[c] for c in order]}
    )


def select_rounds(masses: DataFrame) -> DataFrame:
    """What ``_select`` gives, in logarithmic rounds and without a whole tree in one task.

    Sizes and peaks of subtrees add up over ancestors one, two, four, ... steps away. A cluster's score is
    known once those of its parts are; where one part is still open, it is the larger of the
    cluster's own mass and a sum plus that part, and such steps along a path are composed by doubling.
    Choices come down by doubling as well: the highest kept cluster wins.
    """
    density = lambda w: F.when(F.col(w) > 0, 1 / F.col(w)).otherwise(float("inf"))
    number = F.coalesce(F.col("n_own"), F.lit(0))
    kids = masses.where(F.col("parent").isNotNull()).groupBy(NODE, F.col("parent").alias("cluster")).agg(F.max(density("w_end")).alias("split"), F.count("*").alias("kids"))
    base = hold(masses.join(kids, [NODE, "cluster"], "left").withColumn("birth", F.when(F.col("w_end").isNull(), 0.0).otherwise(density("w_end"))))
    jumps, jump = [], base.where(F.col("parent").isNotNull()).select(NODE, "cluster", F.col("parent").alias("up"))
    while not (jump := hold(jump)).isEmpty():
        jumps.append(jump)
        jump = jump.join(jump.select(NODE, F.col("cluster").alias("up"), F.col("up").alias("up2")), [NODE, "up"]).select(NODE, "cluster", F.col("up2").alias("up"))
    sums = base.select(NODE, "cluster", number.cast("double").alias("size"), F.greatest(F.coalesce("d_max", F.lit(0.0)), F.coalesce("split", F.lit(0.0))).alias("peak"))
    for jump in jumps:
        below = jump.join(sums, [NODE, "cluster"]).groupBy(NODE, F.col("up").alias("cluster")).agg(F.sum("size").alias("s2"), F.max("peak").alias("p2"))
        sums = hold(sums.join(below, [NODE, "cluster"], "left").select(NODE, "cluster", (F.col("size") + F.coalesce("s2", F.lit(0.0))).alias("size"), F.greatest("peak", F.coalesce("p2", F.lit(0.0))).alias("peak")))
    own = F.when(number > 0, F.col("d_sum") - number * F.col("birth")).otherwise(0.0)
    mass = own + F.when(F.col("kids") > 0, (F.col("size") - number) * (F.col("split") - F.col("birth"))).otherwise(0.0)
    known = base.join(sums, [NODE, "cluster"]).withColumn("mass", F.when(F.isnan(mass), 0.0).otherwise(mass))
    known = hold(known.select(NODE, "cluster", "parent", "peak", "mass", F.coalesce("kids", F.lit(0)).alias("kids")))
    # score: known; else ``part`` is the one open cluster below, and score = max(most, plus + its score).
    state = hold(known.select(NODE, "cluster", "parent", "mass", F.when(F.col("kids") == 0, F.col("mass")).alias("score"), F.lit(None).cast("double").alias("most"), F.lit(None).cast("double").alias("plus"), F.lit(None).cast("bigint").alias("part")))
    while not state.where(F.col("score").isNull()).isEmpty():
        closed = F.col("score").isNotNull()
        below = state.where(F.col("parent").isNotNull()).groupBy(NODE, F.col("parent").alias("cluster")).agg(
            F.count(F.when(~closed, 1)).alias("open"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("sum"), F.max(F.when(~closed, F.col("cluster"))).alias("only")
        )
        met = state.join(below, [NODE, "cluster"], "left")
        ready = F.col("score").isNull() & F.col("part").isNull()
        met = met.select(
            NODE, "cluster", "parent", "mass", F.when(ready & (F.col("open") == 0), F.greatest("mass", "sum")).otherwise(F.col("score")).alias("score"),
            F.when(ready & (F.col("open") == 1), F.col("mass")).otherwise(F.col("most")).alias("most"), F.when(ready & (F.col("open") == 1), F.col("sum")).otherwise(F.col("plus")).alias("plus"),
            F.when(ready & (F.col("open") == 1), F.col("only")).otherwise(F.col("part")).alias("part"),
        )
        met = hold(met)
        step = met.select(NODE, F.col("cluster").alias("part"), F.col("score").alias("score2"), F.col("most").alias("most2"), F.col("plus").alias("plus2"), F.col("part").alias("part2"))
        both = met.join(step, [NODE, "part"], "left")
        onward = F.col("score").isNull() & F.col("part2").isNotNull() & F.col("score2").isNull()
        state = hold(both.select(
            NODE, "cluster", "parent", "mass", F.when(F.col("score").isNull() & F.col("score2").isNotNull(), F.greatest(F.col("most"), F.col("plus") + F.col("score2"))).otherwise(F.col("score")).alias("score"),
            F.when(onward, F.greatest(F.col("most"), F.col("plus") + F.col("most2"))).otherwise(F.col("most")).alias("most"),
            F.when(onward, F.col("plus") + F.col("plus2")).otherwise(F.col("plus")).alias("plus"), F.when(onward, F.col("part2")).otherwise(F.col("part")).alias("part"),
        ))
    parts = state.where(F.col("parent").isNotNull()).groupBy(NODE, F.col("parent").alias("cluster")).agg(F.sum("score").alias("parts"))
    keep = F.col("parent").isNotNull() & (F.col("parts").isNull() | (F.col("mass") >= F.col("parts")))
    chosen = hold(state.join(parts, [NODE, "cluster"], "left").select(NODE, "cluster", F.when(keep, F.col("cluster")).alias("selected")))
    for jump in jumps:
        over = chosen.select(NODE, F.col("cluster").alias("up"), F.col("selected").alias("higher"))
        chosen = hold(chosen.join(jump, [NODE, "cluster"], "left").join(over, [NODE, "up"], "left").select(NODE, "cluster", F.coalesce("higher", "selected").alias("selected")))
    return chosen.join(known.select(NODE, "cluster", "peak"), [NODE, "cluster"])


def hdbscan(points: DataFrame, min_cluster_size: int, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, row_id, label, outlier_score) of hierarchical density clustering, every node on its own.

    The outlier score compares the density at which a row joined with the densest point of
    the cluster it joined. A node that never splits is all noise.
    """
    points = cut_lineage(points.select(NODE, "row_id", "features"))
    rows = points.select(NODE, "row_id")
    tree = mutual_spanning_tree(points, min_samples, block_rows)
    joined, skeleton = _grow_clusters(rows, tree, min_cluster_size)
    clusters = _cluster_tree(joined, skeleton)
    placed = hold(_place_rows(joined, clusters))
    masses = _stabilities(placed, clusters)
    if _most_rows(clusters) <= 2 * SKELETON_ROWS:
        picks = hold(masses.groupBy(NODE).applyInPandas(_select, "node_id string, cluster bigint, selected bigint, peak double"))
    else:
        picks = hold(select_rounds(masses))
    both = placed.join(picks, [NODE, "cluster"])
    density = F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(float("inf"))
    odd = (F.col("peak") == 0) | (density == float("inf"))
    score = F.when(odd, 0.0).when(F.col("peak") == float("inf"), 1.0).otherwise((F.col("peak") - density) / F.col("peak"))
    scored = both.select(NODE, "row_id", "selected", score.alias("outlier_score"))
    labels = _with_labels(rows, scored.where(F.col("selected").isNotNull()), "selected")
    return labels.join(scored.select(NODE, "row_id", "outlier_score"), [NODE, "row_id"], "left")


# ---- validity -----------------------------------------------------------------------------


def density_validity(points: DataFrame, label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, dbcv, status, n_clusters): density-based validity after Moulavi et al. (2014).

    Clusters of one row and rows with a feature that is null or not finite count as noise. With fewer than two clusters there is no score and
    the status says how many there were. Each cluster is a node of its own while its inner
    distances are needed; between clusters only the least distance per pair is kept.
    """
    named = points.select(NODE, "row_id", "features", F.col(label).cast("int").alias("label"))
    total = named.groupBy(NODE).agg(F.count("*").alias("n_all"))
    named = finite_rows(named, "features")
    sizes = named.where(F.col("label") >= 0).groupBy(NODE, "label").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    kept = cut_lineage(named.join(sizes, [NODE, "label"]).withColumn("whole", F.col(NODE)))
    inner = kept.select(F.concat_ws("|", "whole", F.col("label").cast("string")).alias(NODE), "row_id", "features", "whole", "label", "n")

    def closeness(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        x, y, squares = matrix(q["features"]), matrix(s["features"]), Squares(matrix(q["features"]), matrix(s["features"]))
        mine, ids, top, rest = q["row_id"].to_numpy(), s["row_id"].to_numpy(), np.empty(len(q)), np.empty(len(q))
        for at in slices(len(q), TILE_ROWS):
            with np.errstate(divide="ignore"):
                power = -x.shape[1] * np.log(lengths(x, y, squares, at))
            power[mine[at, None] == ids[None, :]] = -np.inf
            top[at] = power.max(axis=1)
            base = np.where(np.isfinite(top[at]), top[at], 0.0)
            summed = np.exp(np.where(np.isposinf(power), 0.0, power) - base[:, None]).sum(axis=1)
            rest[at] = np.where(np.isposinf(top[at]), 1.0, summed)
        return pd.DataFrame({"node_id": q[NODE], "row_id": q["row_id"], "top": np.where(np.isneginf(top), -1e308, np.where(np.isposinf(top), 1e308, top)), "rest": rest})

    rows = inner.select(NODE, "row_id", "features")
    parts, _ = block_join(rows, rows, closeness, "node_id string, row_id bigint, top double, rest double", "features", None, block_rows)
    peak = parts.groupBy(NODE, "row_id").agg(F.max("top").alias("peak"))
    summed = parts.join(peak, [NODE, "row_id"]).groupBy(NODE, "row_id").agg(F.max("peak").alias("peak"), F.sum(F.col("rest") * F.exp(F.col("top") - F.col("peak"))).alias("mass"))
    dims = F.size("features").cast("double")
    core = F.when(F.col("peak") >= 1e308, 0.0).otherwise(F.exp(-(F.col("peak") + F.log("mass") - F.log(F.col("n") - 1.0)) / dims))
    cored = hold(inner.join(summed, [NODE, "row_id"]).select(NODE, "row_id", "features", "whole", "label", "n", core.alias("core")))

    tree = mutual_spanning_tree(cored, 0, block_rows, apart="core")
    ends = tree.select(NODE, F.col("a").alias("row_id")).unionByName(tree.select(NODE, F.col("b").alias("row_id")))
    degree = hold(ends.groupBy(NODE, "row_id").agg(F.count("*").alias("degree")))
    deg = lambda c: degree.select(NODE, F.col("row_id").alias(c), F.col("degree").alias(f"d_{c}"))
    marked = tree.join(deg("a"), [NODE, "a"]).join(deg("b"), [NODE, "b"])
    inside = (F.col("d_a") > 1) & (F.col("d_b") > 1)
    sparse = marked.groupBy(NODE).agg(F.coalesce(F.max(F.when(inside, F.col("w"))), F.max("w")).alias("sparseness"))
    tops = degree.groupBy(NODE).agg(F.max("degree").alias("top"))
    hubs = degree.join(tops, NODE).where((F.col("degree") > 1) | (F.col("top") == 1)).select(NODE, "row_id")
    core_rows = hold(cored.join(hubs, [NODE, "row_id"]).select(F.col("whole").alias(NODE), "row_id", "features", "label", "core"))

    def between(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        x, y, squares = matrix(q["features"]), matrix(s["features"]), Squares(matrix(q["features"]), matrix(s["features"]))
        mine, theirs, ql, sl = q["core"].to_numpy(), s["core"].to_numpy(), q["label"].to_numpy(), s["label"].to_numpy()
        near = np.full(len(q), np.inf)
        for at in slices(len(q), TILE_ROWS):
            w = np.maximum(lengths(x, y, squares, at), np.maximum(mine[at, None], theirs[None, :]))
            w[ql[at, None] == sl[None, :]] = np.inf
            near[at] = w.min(axis=1)
        found = [(a, near[ql == a].min()) for a in np.unique(ql) if (sl != a).any()]
        return pd.DataFrame({"node_id": [q[NODE].iloc[0]] * len(found), "label": [a for a, _ in found], "apart": [v for _, v in found]})

    gaps, _ = block_join(core_rows, core_rows, between, "node_id string, label int, apart double", "features", None, block_rows)
    apart = gaps.groupBy(NODE, "label").agg(F.min("apart").alias("separation"))
    keyed = sparse.select(F.split(NODE, "\\|")[0].alias(NODE), F.split(NODE, "\\|")[1].cast("int").alias("label"), "sparseness")
    widest = F.greatest("separation", "sparseness")
    value = F.when(widest > 0, (F.col("separation") - F.col("sparseness")) / widest).otherwise(0.0)
    scored = sizes.join(keyed, [NODE, "label"]).join(apart, [NODE, "label"]).withColumn("v", value)
    per = scored.groupBy(NODE).agg(F.sum(F.col("v") * F.col("n")).alias("s"))
    counts = sizes.groupBy(NODE).agg(F.count("*").alias("n_clusters"))
    out = total.join(counts, NODE, "left").join(per, NODE, "left").withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0)))
    enough = F.col("n_clusters") >= 2
    return out.select(
        NODE, F.when(enough, F.col("s") / F.col("n_all")).alias("dbcv"),
        F.when(enough, "ok").otherwise(F.concat(F.lit("degenerate:"), F.col("n_clusters").cast("string"), F.lit("_clusters"))).alias("status"), "n_clusters",
    )
