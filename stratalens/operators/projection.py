"""Projections of every node: principal axes, distance scaling, neighbour graphs.

Points are (node_id, row_id, features); projections are (node_id, row_id, coordinates). A row
with a feature that is null or not finite has no coordinates and counts nowhere; a node of fewer
than two other rows, or of fewer than two columns, has no projection.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hold
from .blocks import BLOCK_ROWS, NODE, TILE_ROWS, Squares, block_join, distances, lengths, matrix, slices
from .neighbours import knn



# ---- principal axes -----------------------------------------------------------------------


def complete(points: DataFrame) -> DataFrame:
    """Rows whose features are all there and finite."""
    good = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return points.where(F.col("features").isNotNull() & good)


def _partial_moments(batches):
    """Per node and partition: row count, sums and sums of products of the rows less the node's origin."""
    held: dict[str, list] = {}
    for pdf in batches:
        for node, at in pdf.groupby(NODE).indices.items():
            x = matrix(pdf["features"].iloc[at]) - np.asarray(pdf["origin"].iloc[at[0]], dtype=float)
            entry = held.setdefault(node, [0, 0.0, 0.0])
            entry[0] += len(x)
            entry[1] = entry[1] + x.sum(axis=0)
            entry[2] = entry[2] + x.T @ x
        if len(held) >= 64:
            yield _moment_rows(held)
            held = {}
    if held:
        yield _moment_rows(held)


def _moment_rows(held: dict) -> pd.DataFrame:
    return pd.DataFrame(
        {"node_id": list(held), "n": [e[0] for e in held.values()], "moments": [np.concatenate([e[1], e[2].ravel()]) for e in held.values()]}
    )


def _axes(dims: int, count: int):
    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, values = int(pdf["n"].iloc[0]), pdf["value"].to_numpy()
        if not np.isfinite(values).all():  # beyond what a double holds: no projection of this node
            return pd.DataFrame({"node_id": [], "n_points": [], "center": [], "axes": [], "explained_variance": []})
        mean = values[:dims] / n
        cov = (values[dims:].reshape(dims, dims) - n * np.outer(mean, mean)) / (n - 1)
        size, vectors = np.linalg.eigh((cov + cov.T) / 2)
        order = np.argsort(size)[::-1][:count]
        vectors = vectors[:, order].T
        # Sign rule: the largest loading of an axis is positive.
        flip = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
        vectors = vectors * np.where(flip == 0, 1.0, flip)[:, None]
        total = max(size.clip(min=0).sum(), 0.0)
        ratio = (size[order].clip(min=0) / total).tolist() if total > 0 else [None] * count
        return pd.DataFrame(
            {"node_id": [pdf[NODE].iloc[0]], "n_points": [n], "center": [mean + np.asarray(pdf["origin"].iloc[0], dtype=float)], "axes": [[list(v) for v in vectors]], "explained_variance": [ratio]}
        )

    return axes


def principal_axes(points: DataFrame, dims: int, count: int = 2) -> DataFrame:
    """(node_id, n_points, center, axes, explained_variance) from the covariance of each node.

    Sums run over the rows less one row of the node, so that no digits are lost where the mean
    is far larger than the spread. One pass leaves dims + dims squared sums per node and
    partition; they are added up by position, and only the finished d x d matrix of a node
    meets the eigensolver.
    """
    rows = complete(points)
    origin = rows.groupBy(NODE).agg(F.min_by("features", "row_id").alias("origin"))
    schema = "node_id string, n bigint, moments array<double>"
    parts = rows.select(NODE, "features").join(origin, NODE).mapInPandas(_partial_moments, schema)
    cells = parts.select(NODE, "n", F.posexplode("moments").alias("pos", "value"))
    sums = cells.groupBy(NODE, "pos").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).where("n >= 2").join(origin, NODE)
    out = "node_id string, n_points bigint, center array<double>, axes array<array<double>>, explained_variance array<double>"
    return sums.groupBy(NODE).applyInPandas(_axes(dims, count), out)


def _along(axis: Column) -> Column:
    shifted = F.zip_with("features", "center", lambda x, m: x - m)
    return F.aggregate(F.zip_with(shifted, axis, lambda x, v: x * v), F.lit(0.0), lambda acc, x: acc + x)


def pca(points: DataFrame, dims: int, count: int = 2) -> tuple[DataFrame, DataFrame]:
    """((node_id, row_id, coordinates), axes): centred principal coordinates of every node."""
    if dims < 2:
        empty = points.select(NODE, "row_id", F.lit(None).cast("array<double>").alias("coordinates")).limit(0)
        return empty, principal_axes(points, dims, min(count, dims)).limit(0)
    count = min(count, dims)
    axes = hold(principal_axes(points, dims, count))
    placed = complete(points).select(NODE, "row_id", "features").join(axes, NODE)
    coordinates = F.array(*[_along(F.col("axes")[i]) for i in range(count)])
    return placed.select(NODE, "row_id", coordinates.alias("coordinates")), axes


def as_xy(coordinates: DataFrame) -> DataFrame:
    return coordinates.select(NODE, "row_id", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y"))


# ---- distance scaling ---------------------------------------------------------------------

SETTLED = 1e-4


def _pulls(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
    """Per row of ``q``: sums of (target / present distance) times the way from each row of ``s``, and its squared misfit."""
    x, y, a, b = matrix(q["xy"]), matrix(s["xy"]), matrix(q["features"]), matrix(s["features"])
    moved, misfit, squares = np.zeros_like(x), np.zeros(len(x)), Squares(a, b)
    for at in slices(len(x), TILE_ROWS):
        target, present = lengths(a, b, squares, at), distances(x[at], y)
        gap = target - present
        misfit[at] = np.einsum("ij,ij->i", gap, gap)
        target[present == 0] = 0.0
        present[present == 0] = 1.0
        share = np.divide(target, present, out=target)
        moved[at] = x[at] * share.sum(axis=1, keepdims=True) - share @ y
    return pd.DataFrame({"node_id": q[NODE], "row_id": q["row_id"], "px": moved[:, 0], "py": moved[:, 1], "misfit": misfit})


def _settle(rounds: int):
    """Stress majorisation of a node that fits one block."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id").reset_index(drop=True)
        stress = None
        for turn in range(rounds + 1):
            step = _pulls(pdf, pdf)
            before, stress = stress, float(step["misfit"].sum()) / 2
            if turn == rounds or stress == 0 or before is not None and before - stress <= SETTLED * before:
                break
            pdf = pdf.assign(xy=list(step[["px", "py"]].to_numpy() / len(pdf)))
        xy = matrix(pdf["xy"])
        return pd.DataFrame({"node_id": pdf[NODE], "row_id": pdf["row_id"], "x": xy[:, 0], "y": xy[:, 1], "stress": stress})

    return settle


def _settle_large(points: DataFrame, rounds: int, block_rows: int) -> DataFrame:
    """The same for nodes of any size: a round is one pass over blocks of row pairs, for all nodes at once."""
    place = hold(points)
    sizes = hold(place.groupBy(NODE).agg(F.count("*").alias("n")))
    stress = None
    for turn in range(rounds + 1):
        schema = "node_id string, row_id bigint, px double, py double, misfit double"
        parts, _ = block_join(place, place, _pulls, schema, "features", None, block_rows)
        sums = hold(parts.groupBy(NODE, "row_id").agg(F.sum("px").alias("px"), F.sum("py").alias("py"), F.sum("misfit").alias("misfit")))
        now = sums.groupBy(NODE).agg((F.sum("misfit") / 2).alias("stress"))
        # A node that has settled keeps its places.
        on = now.withColumn("on", F.col("stress") > 0) if stress is None else now.join(stress.select(NODE, F.col("stress").alias("before"), F.col("on").alias("was")), NODE).select(
            NODE, "stress", (F.col("was") & (F.col("before") - F.col("stress") > SETTLED * F.col("before"))).alias("on")
        )
        stress = hold(on)
        if turn == rounds or stress.where("on").isEmpty():
            break
        moved = place.join(sums, [NODE, "row_id"]).join(sizes, NODE).join(stress, NODE)
        xy = F.when(F.col("on"), F.array(F.col("px") / F.col("n"), F.col("py") / F.col("n"))).otherwise(F.col("xy"))
        place = hold(moved.select(NODE, "row_id", "features", xy.alias("xy")))
    return place.join(stress, NODE).select(NODE, "row_id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"), "stress")


def mds(points: DataFrame, dims: int, metric: bool = True, n_init: int = 1, max_iter: int = 100, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, row_id, x, y) whose distances come as near as possible to those of the features.

    Classical scaling of Euclidean distances is the centred principal projection, so that is
    where the first of ``n_init`` runs starts; further ones start from places drawn by hash.
    Each run minimises the raw stress by majorisation until a round gains less than ``SETTLED``
    of it, ``max_iter`` rounds at most; the run of least stress stays, the first of equals.
    Two columns are only turned by their principal axes: all distances stay and the first run is done
    where it starts, unless row ids of the node repeat.
    """
    if not metric:
        raise ValueError("only metric scaling is available")
    rows = complete(points).select(NODE, "row_id", "features")
    placed, axes = pca(rows, dims, 2)
    start = rows.join(placed, [NODE, "row_id"]).join(axes.select(NODE, "center"), NODE)
    if dims != 2:
        return _majorised(start, n_init, max_iter, seed, block_rows)
    # Where ids repeat, a row meets the places of its namesakes too.
    repeated = hold(rows.groupBy(NODE, "row_id").count().where(F.col("count") > 1).select(NODE).distinct())
    placed = as_xy(start.join(repeated, NODE, "left_anti"))
    if repeated.isEmpty():
        return placed
    return placed.unionByName(_majorised(start.join(repeated, NODE, "left_semi"), n_init, max_iter, seed, block_rows))


def _majorised(start: DataFrame, n_init: int, max_iter: int, seed: int, block_rows: int) -> DataFrame:
    """The runs of ``mds`` from (node_id, row_id, features, coordinates, center), and the best of them."""
    # A run is a node of its own; its number goes before the node's name.
    drawn = lambda i, k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.lit(k), "row_id"), F.lit(1 << 30)) / (1 << 29) - 1.0)
    spread = F.sqrt(F.aggregate(F.zip_with("features", "center", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda acc, x: acc + x))
    runs = start.select(F.concat(F.lit("0 "), NODE).alias(NODE), "row_id", "features", F.col("coordinates").alias("xy"))
    for i in range(1, n_init):
        runs = runs.unionByName(start.select(F.concat(F.lit(f"{i} "), NODE).alias(NODE), "row_id", "features", F.array(drawn(i, 0) * spread, drawn(i, 1) * spread).alias("xy")))
    runs = hold(runs)
    large = hold(runs.groupBy(NODE).agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select(NODE))
    schema = "node_id string, row_id bigint, x double, y double, stress double"
    found = runs.join(large, NODE, "left_anti").groupBy(NODE).applyInPandas(_settle(max_iter), schema)
    if not large.isEmpty():
        found = found.unionByName(_settle_large(runs.join(large, NODE, "left_semi"), max_iter, block_rows))
    found = found.select(F.regexp_extract(NODE, r"(?s)^\d+ (.*)$", 1).alias(NODE), F.regexp_extract(NODE, r"^(\d+) ", 1).cast("int").alias("run"), "row_id", "x", "y", "stress")
    if n_init <= 1:
        return found.drop("run", "stress")
    found = hold(found)
    best = found.groupBy(NODE).agg(F.min(F.struct("stress", "run")).alias("b")).select(NODE, "b.run")
    return found.join(best, [NODE, "run"]).select(NODE, "row_id", "x", "y")


def sibling_layout(centroids: DataFrame, dims: int, n_init: int = 1, max_iter: int = 100, seed: int = 42) -> DataFrame:
    """(node_id, cluster, rel_x, rel_y): the children of a node laid out by the distances of their centroids."""
    points = centroids.select(NODE, F.col("cluster").cast("bigint").alias("row_id"), F.col("centroid").alias("features"))
    placed = mds(points, dims, n_init=n_init, max_iter=max_iter, seed=seed)
    return placed.select(NODE, F.col("row_id").cast("int").alias("cluster"), F.col("x").alias("rel_x"), F.col("y").alias("rel_y"))


# ---- neighbour graphs ---------------------------------------------------------------------


def _lists(points: DataFrame, k: int, block_rows: int) -> DataFrame:
    packed = knn(points, k, block_rows=block_rows)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "dist")))
    return packed.groupBy(NODE, "row_id").agg(ordered.alias("l")).select(NODE, "row_id", F.col("l.neighbour").alias("near"), F.col("l.dist").alias("dist"))


def _padded(column: pd.Series) -> np.ndarray:
    width = max((len(v) for v in column), default=0)
    out = np.full((len(column), width), np.nan)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def perplexity_weights(dist: pd.Series, perplexity: pd.Series) -> pd.Series:
    """Neighbour probabilities whose entropy matches the perplexity, by bisection for all rows at once."""
    d2 = _padded(dist) ** 2
    d2 = d2 - np.nanmin(d2, axis=1, keepdims=True)
    target = np.log(np.minimum(perplexity.to_numpy(), [max(1.0, len(v)) for v in dist]))
    low, high = np.zeros(len(d2)), np.full(len(d2), np.inf)
    beta = np.ones(len(d2))
    for _ in range(64):
        p = np.exp(-np.nan_to_num(d2, nan=np.inf) * beta[:, None])
        p = p / p.sum(axis=1, keepdims=True)
        entropy = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0).sum(axis=1)
        wide = entropy > target
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return pd.Series([row[: len(v)].tolist() for row, v in zip(p, dist)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fuzzy_weights(dist: pd.Series) -> pd.Series:
    """Memberships that decay beyond the nearest neighbour and sum to log2 of the list length."""
    d = _padded(dist)
    width = np.array([len(v) for v in dist])
    rho = np.array([min((x for x in v if x > 0), default=0.0) for v in dist])
    target = np.log2(np.maximum(width, 2))
    gap = np.nan_to_num(np.maximum(d - rho[:, None], 0.0), nan=np.inf)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        total = np.exp(-gap / sigma[:, None]).sum(axis=1)
        over = total > target
        high, low = np.where(over, sigma, high), np.where(over, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    # Scale floor relative to the mean distance, as in the published method (0.001).
    floor = 1e-3 * np.array([np.mean(v) if len(v) else 0.0 for v in dist])
    sigma = np.maximum(np.maximum(sigma, floor), 1e-12)
    w = np.exp(-gap / sigma[:, None])
    return pd.Series([row[: len(v)].tolist() for row, v in zip(w, dist)])


def _edges(lists: DataFrame, weights: str) -> DataFrame:
    cells = lists.select(NODE, F.col("row_id").alias("a"), F.inline(F.arrays_zip(F.col("near").alias("b"), F.col(weights).alias("w"))))
    return cells.select(NODE, "a", "b", "w")


def _both_ways(edges: DataFrame) -> DataFrame:
    """(node_id, a, b, w, w_back) with a < b, each direction's weight (0 where one is missing)."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    there = F.when(F.col("a") < F.col("b"), F.col("w"))
    back = F.when(F.col("a") > F.col("b"), F.col("w"))
    return edges.groupBy(NODE, low.alias("a"), high.alias("b")).agg(
        F.coalesce(F.max(there), F.lit(0.0)).alias("w"), F.coalesce(F.max(back), F.lit(0.0)).alias("w_back")
    )


def affinity_graph(points: DataFrame, perplexity: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, a, b, w), a < b: symmetric neighbour affinities at a perplexity.

    Neighbour lists are three times the perplexity and one long, as usual. The perplexity of a node never exceeds its number of other rows.
    """
    sizes = points.groupBy(NODE).agg(F.greatest(F.lit(1.0), F.count("*") - 1.0).alias("room"))
    lists = _lists(points, max(1, int(3 * perplexity + 1)), block_rows).join(sizes, NODE)
    weighted = lists.withColumn("weights", perplexity_weights("dist", F.least(F.lit(float(perplexity)), "room")))
    both = _both_ways(_edges(weighted, "weights"))
    return both.join(points.groupBy(NODE).agg(F.count("*").alias("n")), NODE).select(NODE, "a", "b", ((F.col("w") + F.col("w_back")) / (2 * F.col("n"))).alias("w"))


def fuzzy_graph(points: DataFrame, n_neighbors: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node_id, a, b, w), a < b: fuzzy union of the directed neighbour memberships."""
    lists = _lists(points, max(1, n_neighbors - 1), block_rows)
    both = _both_ways(_edges(lists.withColumn("weights", fuzzy_weights("dist")), "weights"))
    return both.select(NODE, "a", "b", (F.col("w") + F.col("w_back") - F.col("w") * F.col("w_back")).alias("w"))


def curve_parameters(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^(2b)) fitted to the target curve by a shrinking grid search."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, ra, rb = 1.5, 1.0, 1.4, 0.7
    for _ in range(12):
        grid = [(((1 / (1 + p * x ** (2 * q)) - y) ** 2).sum(), p, q) for p in np.linspace(max(a - ra, 1e-3), a + ra, 15) for q in np.linspace(max(b - rb, 0.1), b + rb, 15)]
        _, a, b = min(grid)
        ra, rb = ra / 2, rb / 2
    return float(a), float(b)


def graph_layout(
    edges: DataFrame, start: DataFrame, count: int = 2, epochs: int = 12, negatives: int = 5, min_dist: float = 0.1,
    rate: float = 1.0, seed: int = 42, lot_rows: int = 64,
) -> DataFrame:
    """(node_id, row_id, coordinates): positions pulled together along edges and pushed from drawn rows.

    Every epoch is the same joins for all rows at once: edges fetch both ends, and the rows of a
    node are dealt anew by hash into lots of about ``lot_rows``, in which each row meets
    ``negatives`` others, so that over the epochs any two rows may meet. The moves are summed
    per row. Positions start from ``start`` (node_id, row_id, coordinates) scaled to a common
    size. Judge the result by trustworthiness; coordinates are not those of a sequential
    optimiser.
    """
    a, b = curve_parameters(min_dist)
    c = [f"c{i}" for i in range(count)]
    sizes = start.groupBy(NODE).agg(F.max(F.array_max(F.transform("coordinates", F.abs))).alias("s"), F.ceil(F.count("*") / lot_rows).alias("lots"))
    scale = F.when(F.col("s") > 0, 10 / F.col("s")).otherwise(0.0)
    peak = edges.groupBy(NODE).agg(F.max("w").alias("w_top"))
    pull = edges.join(peak, NODE).select(NODE, "a", "b", (F.col("w") / F.col("w_top")).alias("w"))
    both = hold(pull.unionByName(pull.select(NODE, F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    place = hold(start.join(sizes, NODE).select(NODE, "row_id", "lots", *[(F.col("coordinates")[i] * scale).alias(c[i]) for i in range(count)]))
    clip = lambda v: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), v))
    plus = lambda values: sum(values[1:], values[0])
    for epoch in range(epochs):
        alpha = rate * (1 - epoch / epochs)
        near = place.select(NODE, F.col("row_id").alias("a"), *[F.col(x).alias(f"a_{x}") for x in c])
        far = place.select(NODE, F.col("row_id").alias("b"), *[F.col(x).alias(f"b_{x}") for x in c])
        gap = [F.col(f"a_{x}") - F.col(f"b_{x}") for x in c]
        d2 = plus([g * g for g in gap])
        grip = F.when(d2 > 0, -2.0 * a * b * F.pow(d2, F.lit(b - 1.0)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(0.0) * F.col("w")
        drawn = both.join(near, [NODE, "a"]).join(far, [NODE, "b"])
        moves = drawn.select(NODE, F.col("a").alias("row_id"), *[clip(grip * g).alias(f"d_{x}") for x, g in zip(c, gap)])
        dealt = place.withColumn("lot", F.pmod(F.xxhash64(F.lit(seed + epoch), "row_id"), F.col("lots")))
        packed = dealt.groupBy(NODE, "lot").agg(F.collect_list(F.struct(F.col("row_id").alias("b"), *[F.col(x).alias(f"b_{x}") for x in c])).alias("others"))
        first = F.pmod(F.xxhash64(F.lit(seed * 31 + epoch), "row_id"), F.size("others")).cast("int")
        picked = F.transform(F.sequence(F.lit(0), F.lit(negatives - 1)), lambda i: F.get("others", F.pmod(first + i, F.size("others")).cast("int")))
        met = dealt.join(packed, [NODE, "lot"]).select(NODE, "row_id", *c, F.explode(F.array_distinct(picked)).alias("o")).where(F.col("o.b") != F.col("row_id"))
        away = [F.col(x) - F.col(f"o.b_{x}") for x in c]
        e2 = plus([g * g for g in away])
        push = F.lit(2.0 * b) / ((e2 + 0.001) * (1 + a * F.pow(e2, F.lit(b))))
        pushed = met.select(NODE, "row_id", *[clip(push * g).alias(f"d_{x}") for x, g in zip(c, away)])
        total = moves.unionByName(pushed).groupBy(NODE, "row_id").agg(*[F.sum(f"d_{x}").alias(f"d_{x}") for x in c], F.count("*").alias("m"))
        step = F.lit(alpha) / F.sqrt(F.col("m"))
        place = hold(
            place.join(total, [NODE, "row_id"], "left").select(NODE, "row_id", "lots", *[(F.col(x) + F.coalesce(step * F.col(f"d_{x}"), F.lit(0.0))).alias(x) for x in c])
        )
    return place.select(NODE, "row_id", F.array(*c).alias("coordinates"))


def project(points: DataFrame, dims: int, config, count: int = 2, method: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """((node_id, row_id, coordinates), axes or None) by the configured method."""
    name = (method or config.method).lower()
    if name == "pca":
        return pca(points, dims, count)
    if name == "mds":
        if count != 2:
            raise ValueError("distance scaling gives two dimensions")
        xy = mds(points, dims, config.mds_metric, config.mds_n_init, config.mds_max_iter, config.mds_random_state)
        return xy.select(NODE, "row_id", F.array("x", "y").alias("coordinates")), None
    rows = complete(points)
    if name == "umap":
        graph, settings = fuzzy_graph(rows, config.umap_n_neighbors), {"min_dist": config.umap_min_dist, "seed": config.umap_random_state}
    elif name == "t-sne":
        # The usual learning rate of 200 is a step of one.
        graph, settings = affinity_graph(rows, config.tsne_perplexity), {"rate": config.tsne_learning_rate / 200.0, "seed": config.tsne_random_state}
    else:
        raise ValueError(f"unknown projection method: {config.method if method is None else method}")
    start, _ = pca(rows, dims, count)
    return graph_layout(graph, start, min(count, dims), config.layout_epochs, **settings), None
