"""Blocked distance work against plain numpy, with blocks small enough to force every path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalens.operators import blocks as BL
from stratalens.operators import counting as CO
from stratalens.operators import faithfulness as FA
from stratalens.operators import neighbours as N
from stratalens.operators.trees import scoring_k


def frame(spark, x, emb=None, label=None, node=None):
    rows = [
        (node[i] if node is not None else "root", i, x[i].tolist(), (emb[i].tolist() if emb is not None else None), int(label[i]) if label is not None else 0)
        for i in range(len(x))
    ]
    return spark.createDataFrame(rows, "node_id string, row_id bigint, features array<double>, embedding array<double>, label int")


def brute_lists(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))
        out[i] = order
    return d, out


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 8, (5, d))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, 1, (n, d))
    x[: n // 3] = x[0]  # a third of the rows are copies of one another
    return x


@pytest.mark.parametrize("block_rows", [40, 4096])
def test_knn_is_exact_with_and_without_pivots(spark, block_rows):
    x = clustered(210, 3, 1)
    got = {}
    for r in N.knn(frame(spark, x), 6, block_rows=block_rows).collect():
        got.setdefault(r.row_id, {})[r["rank"]] = (r.neighbour, r.dist)
    d, want = brute_lists(x, 6)
    for i in range(len(x)):
        assert [got[i][r][0] for r in range(1, 7)] == want[i][:6]
        assert np.allclose([got[i][r][1] for r in range(1, 7)], [d[i, j] for j in want[i][:6]])


@pytest.mark.parametrize("block_rows", [50, 4096])
def test_measures_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    x, emb = rng.normal(size=(120, 6)), rng.normal(size=(120, 2))
    k, n = 20, 120
    points = frame(spark, x, emb)
    sizes = points.groupBy("node_id").agg(F.count("*").alias("n_points")).withColumn("k", scoring_k(F.col("n_points")))
    got = FA.measures(FA.ranked_neighbours(points, block_rows=block_rows), sizes).head()
    _, a = brute_lists(x, k)
    _, b = brute_lists(emb, k)
    ra = [{j: r + 1 for r, j in enumerate(a[i])} for i in range(n)]
    rb = [{j: r + 1 for r, j in enumerate(b[i])} for i in range(n)]
    norm = 2 / (k * (2 * n - 3 * k - 1))
    mnorm = sum(abs(n - 2 * i + 1) / i for i in range(1, k + 1))
    t = np.mean([1 - norm * sum(max(0, ra[i][j] - k) for j in b[i][:k]) for i in range(n)])
    c = np.mean([1 - norm * sum(max(0, rb[i][j] - k) for j in a[i][:k]) for i in range(n)])
    mf = np.mean([1 - sum(abs(ra[i][j] - rb[i][j]) / rb[i][j] for j in b[i][:k]) / mnorm for i in range(n)])
    mm = np.mean([1 - sum(abs(rb[i][j] - ra[i][j]) / ra[i][j] for j in a[i][:k]) / mnorm for i in range(n)])
    assert np.allclose([got.trustworthiness, got.continuity, got.mrre_false, got.mrre_missing], [t, c, mf, mm])
    prof = N.stress(N.distance_profile(points, other="embedding", block_rows=block_rows)).head()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    e = np.sqrt(((emb[:, None] - emb[None]) ** 2).sum(-1))
    assert np.isclose(prof.stress, np.sqrt(((d - e) ** 2).sum() / (d**2).sum()))


@pytest.mark.parametrize("block_rows", [25, 60, 4096])
def test_counts_of_nearer_rows_match_brute_force(spark, block_rows):
    x = clustered(240, 2, 8)
    x[200:220] = x[199]  # ties beside the large group of copies
    d, order = brute_lists(x, 239)
    rng = np.random.default_rng(9)
    asked = [("root", int(i), int(j), float(d[i, j])) for i in range(240) for j in rng.choice(240, 5, replace=False) if i != j]
    asked += [("b", i, (i + 1) % 10, float(d[i, (i + 1) % 10])) for i in range(10)]
    points = frame(spark, x).unionByName(frame(spark, x[:10]).withColumn("node_id", F.lit("b"))).select("node_id", "row_id", "features")
    got = CO.count_nearer(points, spark.createDataFrame(asked, "node_id string, row_id bigint, neighbour bigint, limit double"), block_rows).collect()
    assert len(got) == len(asked)
    for r in got:
        n = 240 if r.node_id == "root" else 10
        assert r.nearer == [j for j in order[r.row_id] if j < n].index(r.neighbour), r


def test_counting_visits_few_cells(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    rows, pivots = BL.placed_rows(frame(spark, x).select("node_id", "row_id", "features"), "features", 50)
    at = [("root", i, [float(v) for v in p]) for i, p in enumerate(pivots["root"])]
    pivot = spark.createDataFrame(at, "node_id string, cell int, pivot array<double>")
    cells = rows.groupBy("node_id", "cell").agg(F.count("*").alias("n"), F.max("reach").alias("s_far")).join(pivot, ["node_id", "cell"])
    cells = cells.withColumnsRenamed({"cell": "s_cell", "pivot": "s_pivot"})
    shares = {}
    for limit in (0.1, 4.0):
        facts = {"low": F.lit(limit), "high": F.lit(1.1 * limit), "band": F.lit(0), "rows": F.col("n"), "far": F.col("s_far"), "q_pivot": F.col("s_pivot")}
        ask = cells.withColumns(facts).withColumnRenamed("s_cell", "q_cell").drop("n", "s_far", "s_pivot")
        pairs = F.sum(F.col("rows") * F.col("n")) / 3000**2
        found = CO.cut_plan(ask, cells).groupBy("inside").agg(pairs.alias("share")).collect()
        shares[limit] = {r.inside: r.share for r in found}
    assert shares[0.1][False] < 0.5 and shares[4.0][False] < 0.3 and shares[4.0][True] > 0.7


def test_good_projection_scores_above_noise(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8)) * np.array([6, 5, 1, 1, 1, 1, 1, 1])
    good = FA.score_nodes(frame(spark, x, x[:, :2]))[0].head()
    bad = FA.score_nodes(frame(spark, x, rng.normal(size=(150, 2))))[0].head()
    for m in ["trustworthiness", "continuity", "mrre_false", "mrre_missing"]:
        assert good[m] > bad[m]
    assert good.stress < bad.stress


def test_identical_rows_have_no_stress_but_ranks(spark):
    x = np.ones((20, 3))
    s = FA.score_nodes(frame(spark, x, x[:, :2]))[0].head()
    assert s.stress is None and s.trustworthiness == 1.0


@pytest.mark.parametrize("block_rows", [30, 4096])
def test_silhouette_matches_brute_force(spark, block_rows):
    x = clustered(90, 3, 2)
    label = np.arange(90) % 4 - 1
    got = N.silhouette(frame(spark, x, label=label), block_rows=block_rows).head()
    keep = label >= 0
    x, label = x[keep], label[keep]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        a = d[i, own].mean()
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    assert np.isclose(got.silhouette, np.mean(s))


@pytest.mark.parametrize("block_rows", [30, 4096])
def test_boundary_pool(spark, block_rows):
    x = clustered(80, 3, 4)
    points = frame(spark, x)
    members = [("a", i) for i in range(30, 50)] + [("b", i) for i in range(40, 60)]
    sel = spark.createDataFrame(members, "sel string, row_id bigint")
    got = {(r.sel, r.row_id) for r in N.boundary_pool(points, sel, 4, block_rows).collect()}
    d, _ = brute_lists(x, 4)
    want = set()
    for name in "ab":
        inside = {i for s, i in members if s == name}
        for i in inside:
            want |= {(name, j) for j in sorted(set(range(80)) - inside, key=lambda j: (d[i, j], j))[:4]}
    assert got == want


def test_products_give_the_bits_of_distances():
    """Vectors far from the origin, copies, rounded values with ties, and values no product can hold."""
    rng = np.random.default_rng(11)
    for dims, shift, digits in ((64, 0.0, None), (64, 1e6, 1), (3, 1e4, 0), (13, 0.0, 0), (5, 1e200, None)):
        a, b = rng.normal(size=(150, dims)) + shift, rng.normal(size=(5000, dims)) + shift
        if digits is not None:
            a, b = a.round(digits), b.round(digits)
        b[4200:4300] = a[:100]
        mine, ids = np.arange(150), np.arange(5000)
        d = BL.distances(a, b)
        d[mine[:, None] == ids[None, :]] = np.inf
        rows, cols = BL.smallest(d, ids, 9)
        got = BL.nearest_pairs(a, b, mine, ids, 9)
        assert (got[0] == rows).all() and (got[1] == cols).all() and (got[2] == d[rows, cols]).all()
        limits, targets = d[rows, cols], ids[cols]
        want = CO.count_below(d, ids, rows, limits, targets)
        squares = BL.Squares(a, b)
        assert squares.tame == (shift < 1e100)
        if squares.tame:
            assert (CO._count_rough(a, b, squares, mine, ids, rows, limits, targets) == want).all()
            whole = BL.distances(a, b)
            assert np.allclose(np.concatenate([BL.lengths(a, b, squares, at) for at in BL.slices(150, 64)]), whole, rtol=1e-9, atol=0)


def test_whole_nodes_are_read_by_few_large_chunks(spark):
    sizes = [1, 2048, 2049, 60_000, 600_000]
    got = [r.c for r in spark.createDataFrame([(n,) for n in sizes], "n bigint").select(BL.chunks(F.col("n"), 2048).alias("c")).collect()]
    assert got == [1, 1, 2, 8, 37]


def test_a_wide_block_holds_no_table_of_its_pairs(spark):
    """6 000 rows of 64 dimensions in one block: a few tiles, where all distances would take 288 MB."""
    import tracemalloc

    x = np.random.default_rng(12).normal(size=(6000, 64))
    tracemalloc.start()
    BL.nearest_pairs(x, x, np.arange(6000), np.arange(6000), 10)
    squares = BL.Squares(x, x)
    for at in BL.slices(6000, BL.TILE_ROWS):
        BL.lengths(x, x, squares, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_boundary_pool_sends_rows_once_for_all_selections(spark):
    """Members of several selections and of an unnamed one; the unnamed one leaves out no rows but the asking one."""
    x = clustered(90, 4, 6)
    members = [("a", i) for i in range(30)] + [("b", i) for i in range(20, 60)] + [(None, 85)]
    sel = spark.createDataFrame(members, "sel string, row_id bigint")
    d, order = brute_lists(x, 4)
    want = set()
    for name in ("a", "b", None):
        inside = {i for s, i in members if s == name}
        out = set() if name is None else inside
        for i in inside:
            want |= {(name, j) for j in [j for j in order[i] if j not in out][:4]}
    for block_rows in (25, 4096):
        got = {(r.sel, r.row_id) for r in N.boundary_pool(frame(spark, x), sel, 4, block_rows).collect()}
        assert got == want


def test_rows_visit_few_cells_and_lose_no_neighbour(spark):
    """Cells of 16 rows: a row of a cluster visits cells of its own cluster only; rows without a place neither ask nor answer."""
    rng = np.random.default_rng(21)
    x = rng.normal(0, 30, (8, 3))[rng.integers(0, 8, 640)] + rng.normal(0, 1, (640, 3))
    pivots = {"root": np.unique(x[::16], axis=0)}
    d = BL.distances(x, pivots["root"])
    cell, reach = d.argmin(axis=1), d.min(axis=1)
    facts = [("root", int(c), [], int((cell == c).sum()), float(reach[cell == c].max()), np.sort(reach[cell == c])[:5].tolist()) for c in np.unique(cell)]
    guide = BL.Guide(pivots, facts, 4, [BL.Guide.NONE])
    asks = pd.DataFrame({"node_id": "root", "of": BL.Guide.NONE, "row_id": np.arange(640), "features": x.tolist()})
    first = pd.concat(guide.first("features")([asks]))
    near, order = brute_lists(x, 4)
    kth = np.array([near[i, order[i][3]] for i in range(640)])
    further = pd.concat(guide.others("features")([first.assign(within=kth)]))
    visits = set(zip(first["row_id"], first["q_cell"])) | set(zip(further["row_id"], further["q_cell"]))
    assert all((i, cell[j]) in visits for i in range(640) for j in order[i][:4])
    assert len(visits) < 640 * len(facts) / 3

    holed = x.tolist()
    holed[5][1], holed[6][0] = None, float("nan")
    rows = spark.createDataFrame([("root", i, v) for i, v in enumerate(holed)], "node_id string, row_id bigint, features array<double>")
    got = {}
    for r in N.knn(rows, 4, block_rows=64).collect():
        got.setdefault(r.row_id, {})[r["rank"]] = r.neighbour
    kept = [i for i in range(640) if i not in (5, 6)]
    assert sorted(got) == kept
    for i in kept:
        assert [got[i][r] for r in range(1, 5)] == [j for j in sorted(kept, key=lambda j: (near[i, j], j)) if j != i][:4]
