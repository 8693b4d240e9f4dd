"""Density clustering against direct single-machine definitions on small fixtures."""

import numpy as np
import pytest

from stratalens.operators import density as D
from tests.test_blocks import frame


def pairwise(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def blobs(seed, n=150, noise=20):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [9, 9, 9]])
    x = centres[rng.integers(0, 4, n)] + rng.normal(0, 1, (n, 3))
    return np.vstack([x, rng.uniform(-6, 16, (noise, 3))])


def brute_hdbscan(x, m, k):
    """Condensed tree by definition: components of the mutual reachability graph at every weight."""
    n = len(x)
    d = pairwise(x)
    core = np.sort(d, axis=1)[:, k]
    mr = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges = sorted((mr[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    up = list(range(n))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    merges, comp = [], {i: frozenset([i]) for i in range(n)}
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            merges.append((w, comp[a], comp[b]))
            comp[a] = comp[a] | comp[b]
            up[b] = a

    def walk(points, birth):
        """(points, birth, mass, children, leave) of the cluster that has these points just below ``birth``."""
        leave, mass = {}, 0.0
        todo = points
        while True:
            inner = [mm for mm in merges if (mm[1] | mm[2]) == todo]
            if not inner:
                return dict(points=points, leave=leave, mass=mass, kids=[])
            w, a, b = inner[0]
            lam = 1 / w
            big = [p for p in (a, b) if len(p) >= m]
            if len(big) == 2:
                mass += len(todo) * (lam - birth)
                return dict(points=points, leave=leave, mass=mass, kids=[walk(a, lam), walk(b, lam)])
            gone = todo if not big else (todo - big[0])
            for p in gone:
                leave[p] = lam
            mass += len(gone) * (lam - birth)
            if not big:
                return dict(points=points, leave=leave, mass=mass, kids=[])
            todo = big[0]

    root = walk(frozenset(range(n)), 0.0)
    labels, out = np.full(n, -1), np.zeros(n)

    def settle(c, top):
        parts = [settle(k, False) for k in c["kids"]]
        score = sum(p[0] for p in parts)
        chosen = [q for p in parts for q in p[1]]
        if not top and (not parts or c["mass"] >= score):
            return c["mass"], [c]
        return score, chosen

    def peaks(c):
        best = max([*c["leave"].values(), *(peaks(k) for k in c["kids"])])
        for p, lam in c["leave"].items():
            out[p] = (best - lam) / best
        return best

    def everything(c):
        got = set(c["leave"])
        for k in c["kids"]:
            got |= everything(k)
        return got

    peaks(root)
    groups = sorted((sorted(everything(c)) for c in settle(root, True)[1]), key=lambda g: g[0])
    for i, g in enumerate(groups):
        labels[g] = i
    return labels, out


@pytest.mark.parametrize("seed,m,k,block_rows", [(1, 10, 4, 4096), (2, 6, 3, 60), (3, 20, 5, 4096)])
def test_hdbscan_matches_definition(spark, seed, m, k, block_rows):
    x = blobs(seed)
    want, odd = brute_hdbscan(x, m, k)
    got = sorted(D.hdbscan(frame(spark, x), m, k, block_rows).collect(), key=lambda r: r.row_id)
    assert [r.label for r in got] == want.tolist()
    assert np.allclose([r.outlier_score for r in got], odd, atol=1e-9)


def test_nodes_are_clustered_independently(spark):
    a, b = blobs(4, 80, 8), blobs(5, 90, 5)
    both = frame(spark, np.vstack([a, b]), node=["left"] * len(a) + ["right"] * len(b))
    got = sorted(D.hdbscan(both, 8, 3).collect(), key=lambda r: r.row_id)
    assert [r.label for r in got[: len(a)]] == brute_hdbscan(a, 8, 3)[0].tolist()
    assert [r.label for r in got[len(a) :]] == brute_hdbscan(b, 8, 3)[0].tolist()


def test_merge_rounds_give_the_same_tree(spark):
    rng = np.random.default_rng(0)
    n = 12
    weights = rng.permutation(n - 1) + 1.0
    rows = [("root", i + 1, int(rng.integers(0, i + 1)), float(weights[i]), i + 1, 0) for i in range(n - 1)]
    merges = spark.createDataFrame(rows, "node_id string, x bigint, y bigint, w double, a bigint, b bigint")
    seeds = spark.createDataFrame([("root", i) for i in range(n)], "node_id string, x bigint")
    joined = seeds.selectExpr("node_id", "x as row_id", "x as seed", "0.0D as w")
    shape = lambda t: sorted((r.w_end, r.cluster >= 0, r.parent is None) for r in t.where("w_end is not null").collect())
    one, many = D._cluster_tree(joined, merges), D.merge_rounds(merges, seeds)
    assert shape(one) == shape(many)
    leaf = lambda t: {r.cluster: r.w_end for r in t.collect() if r.cluster >= 0}
    assert leaf(one) == leaf(many)


@pytest.mark.parametrize("block_rows", [50, 4096])
def test_dbscan_matches_definition(spark, block_rows):
    x, eps, k = blobs(6), 1.6, 5
    near = pairwise(x) <= eps
    core = near.sum(1) >= k
    label = np.full(len(x), -1)
    nxt = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], nxt
            while todo:
                p = todo.pop()
                for j in np.nonzero(near[p] & core & (label < 0))[0]:
                    label[j] = nxt
                    todo.append(j)
            nxt += 1
    for i in np.nonzero(~core)[0]:
        reach = label[near[i] & core]
        if len(reach):
            label[i] = reach.min()
    got = sorted(D.dbscan(frame(spark, x), eps, k, block_rows).collect(), key=lambda r: r.row_id)
    assert [r.label for r in got] == label.tolist()


@pytest.mark.parametrize("block_rows", [50, 4096])
def test_density_validity(spark, block_rows):
    x = blobs(7, 100, 0)
    label = np.where(x[:, 0] > 4.5, 1, 0) + np.where(x[:, 1] > 4.5, 2, 0)
    got = D.density_validity(frame(spark, x, label=label), block_rows=block_rows).head()
    d, dims = pairwise(x), 3
    core = np.zeros(len(x))
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        core[i] = (((1 / d[i, same]) ** dims).sum() / same.sum()) ** (-1 / dims)
    mr = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    kinds = [c for c in np.unique(label) if (label == c).sum() >= 2]
    sparse, hubs = {}, {}
    for c in kinds:
        ids = np.nonzero(label == c)[0]
        edges, inside, rest = [], {ids[0]}, set(ids[1:])
        while rest:
            w, _, _, a, b = min((mr[a, b], *sorted((a, b)), a, b) for a in inside for b in rest)
            edges.append((w, a, b))
            inside.add(b)
            rest.remove(b)
        deg = np.bincount([v for _, a, b in edges for v in (a, b)], minlength=len(x))
        inner = [w for w, a, b in edges if deg[a] > 1 and deg[b] > 1]
        sparse[c] = max(inner or [w for w, _, _ in edges])
        hubs[c] = [i for i in ids if deg[i] > 1] or list(ids)
    total = 0.0
    for c in kinds:
        sep = min(mr[np.ix_(hubs[c], hubs[e])].min() for e in kinds if e != c)
        total += (label == c).sum() / len(x) * (sep - sparse[c]) / max(sep, sparse[c])
    assert got.status == "ok" and np.isclose(got.dbcv, total)
    lone = D.density_validity(frame(spark, x, label=np.zeros(len(x)))).head()
    assert lone.dbcv is None and lone.status == "degenerate:1_clusters"


@pytest.mark.parametrize("chunk", [7, 4096])
def test_centre_methods_per_node(spark, chunk, monkeypatch):
    """Every node finds its own clusters, and k-means agrees with plain Lloyd rounds from the same result."""
    from stratalens.operators import clustering as C

    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(8)
    rows, truth = [], {}
    for node, middles in (("a", [(0, 0), (9, 0)]), ("b", [(500, 500), (500, 512)])):
        for i in range(60):
            rows.append((node, len(rows), (np.array(middles[i % 2]) + rng.normal(size=2)).tolist()))
            truth[len(rows) - 1] = (node, i % 2)
    rows.append(("a", 999, [None, 1.0]))
    points = spark.createDataFrame(rows, "node_id string, row_id bigint, features array<double>")
    for found in (C.kmeans(points, 2), C.gaussian_mixture(points, 2)):
        got = {r.row_id: (r.node_id, r.label) for r in found.collect()}
        assert got.keys() == truth.keys()
        assert len({(truth[i], got[i]) for i in got}) == 4
    found = {r.row_id: r.label for r in C.kmeans(points.where("node_id = 'a'"), 3).collect()}
    x = {r[1]: np.array(r[2]) for r in rows if r[0] == "a" and r[1] != 999}
    centres = np.array([np.mean([x[i] for i in found if found[i] == j], axis=0) for j in range(3)])
    moved = sum(int(((x[i] - centres) ** 2).sum(axis=1).argmin()) != found[i] for i in found)
    assert moved <= 2


def test_rows_climb_deep_trees(spark):
    """A chain of clusters and a random tree against climbing step by step."""
    from stratalens.operators.density import _place_rows

    rng = np.random.default_rng(4)
    parent = {("chain", i): i - 1 if i else None for i in range(70)} | {("tree", i): int(rng.integers(i)) if i else None for i in range(60)}
    w_end = {}
    for (n, i), p in parent.items():  # a cluster ends before its parent does
        w_end[n, i] = None if p is None else (100.0 if w_end[n, p] is None else w_end[n, p]) - float(rng.uniform(0.1, 1))
    clusters = spark.createDataFrame([(n, i, p, w_end[n, i]) for (n, i), p in parent.items()], "node_id string, cluster bigint, parent bigint, w_end double")
    joined = [(n, k, i, float(rng.uniform(20, 101))) for k, (n, i) in enumerate([*parent] * 3)]
    got = {(r.node_id, r.row_id): r.cluster for r in _place_rows(spark.createDataFrame(joined, "node_id string, row_id bigint, seed bigint, w double"), clusters).collect()}
    for n, k, i, w in joined:
        while w_end[n, i] is not None and w > w_end[n, i]:
            i = parent[n, i]
        assert got[n, k] == i


def kruskal(n, merges):
    """{(sorted seeds of a cluster): weight at which it ended} by merging one by one."""
    of, ends = {i: frozenset([i]) for i in range(n)}, {}
    for w, a, b in sorted(merges):
        x, y = of[a], of[b]
        ends[x] = ends[y] = w
        for v in x | y:
            of[v] = x | y
    return {tuple(sorted(k)): v for k, v in ends.items()}


def as_sets(rows):
    """The same from a cluster table."""
    parent = {r.cluster: r.parent for r in rows}
    under = {c: set() for c in parent}
    for c in parent:
        if c >= 0:
            up = c
            while up is not None:
                under[up].add(c)
                up = parent[up]
    return {tuple(sorted(under[r.cluster])): r.w_end for r in rows if r.parent is not None}


@pytest.mark.parametrize("kind", ["rising", "random", "comb", "star"])
def test_merge_rounds_of_many_shapes(spark, kind, monkeypatch):
    """Chains and trees of 64 groups against merging one by one, in few rounds."""
    rng = np.random.default_rng(len(kind))
    n = 65
    edges = {"rising": lambda i: (i, i + 1, i + 1.0), "random": lambda i: (int(rng.integers(0, i + 1)), i + 1, float(rng.permutation(10**6)[0])), "comb": lambda i: (i, i + 1, float((i * 37) % 64)), "star": lambda i: (0, i + 1, float((i * 11) % 64))}[kind]
    merges = [(w, a, b) for a, b, w in map(edges, range(n - 1))]
    rows = [("root", a, b, w, a, b) for w, a, b in merges]
    frame_ = spark.createDataFrame(rows, "node_id string, x bigint, y bigint, w double, a bigint, b bigint")
    levels = []
    chains = D._with_chains
    monkeypatch.setattr(D, "_with_chains", lambda *a: levels.append(1) or chains(*a))
    got = D.merge_rounds(frame_, spark.createDataFrame([("root", i) for i in range(n)], "node_id string, x bigint")).collect()
    assert as_sets(got) == kruskal(n, merges) and len(got) == 2 * n - 1
    assert len(levels) <= 7 and (kind != "rising" or len(levels) == 1)


@pytest.mark.parametrize("seed,m,k", [(1, 5, 4), (2, 3, 3)])
def test_hdbscan_without_whole_trees_in_a_task(spark, monkeypatch, seed, m, k):
    x = blobs(seed)
    monkeypatch.setattr(D, "SKELETON_ROWS", 0)
    want, odd = brute_hdbscan(x, m, k)
    got = sorted(D.hdbscan(frame(spark, x), m, k, 60).collect(), key=lambda r: r.row_id)
    assert [r.label for r in got] == want.tolist()
    assert np.allclose([r.outlier_score for r in got], odd, atol=1e-9)


@pytest.mark.parametrize("k", [3, 20])
def test_spanning_tree_of_many_blocks(spark, k):
    """The same edges as one block's, also with copies, ties on a lattice and far groups, and a few per row held."""
    rng = np.random.default_rng(k)
    lattice = np.array([(i, j, 0) for i in range(9) for j in range(9)], dtype=float)
    x = np.vstack([blobs(k, 120, 10), lattice + 100, lattice[:20] + 100, np.full((25, 3), -50.0), rng.normal(size=(60, 3)) * 0.01 + 300])
    points = frame(spark, x)
    edges = lambda t: {(r.a, r.b): round(r.w, 9) for r in t.collect()}
    one, many = edges(D.mutual_spanning_tree(points, k, 4096)), edges(D.mutual_spanning_tree(points, k, 40))
    assert len(one) == len(x) - 1 and one == many


def test_spanning_tree_plan_has_no_tree_per_pair_of_blocks(spark, monkeypatch):
    held = []
    keep = D._with_ends
    monkeypatch.setattr(D, "_with_ends", lambda found, state: held.append(found.count()) or keep(found, state))
    x = blobs(9, 600, 40)
    D.mutual_spanning_tree(frame(spark, x), 4, 40)
    assert max(held) <= len(x)
