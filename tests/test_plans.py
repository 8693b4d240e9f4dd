"""Whole analyses and the smaller contracts around them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.catalog.inputs import LETTER_COLUMNS, letter_points, letter_rows, table
from stratalens.config import Config
from stratalens.operators import projection as PR
from stratalens.operators import rows as R
from stratalens.operators import stability as S
from stratalens.plans.analyse import TABLES, analyse, analyse_stored
from stratalens.plans.describe import describe_selection
from stratalens.roles import extra_columns, feature_columns, target_columns
from stratalens.session import shared_dir
from stratalens.sources.identity import assign_row_id, subsample, train_validation_split
from stratalens.sources.runs import RunStore
from tests.test_blocks import frame
from tests.test_density import blobs
from tests.test_ranges import brute


@pytest.fixture(scope="module")
def built(spark):
    x = blobs(11, 160, 10)
    rows = [(i, *map(float, x[i]), float(i % 7)) for i in range(len(x))]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, extra double")
    config = Config.of(hierarchical_layers=2, hclust_min_cluster_size=12, hclust_min_samples=4, hclust_umap_n_components=0)
    return df, config, {k: v.toPandas() for k, v in analyse(df, ["a", "b", "c"], config, ["extra"]).items()}


def test_tree_tables_fit_together(built):
    _, config, t = built
    nodes, members = t["nodes"].set_index("node_id"), t["membership"]
    assert set(t) == set(TABLES)
    assert nodes.loc["root", "n_points"] == 170 and not nodes.loc["root", "is_leaf"]
    assert members.groupby("node_id").size().to_dict() == nodes["n_points"].to_dict()
    assert nodes["depth"].max() <= config.hierarchical_layers
    for name, r in nodes[nodes.depth > 0].iterrows():
        parent = set(members[members.node_id == r.parent_id].row_id)
        assert set(members[members.node_id == name].row_id) <= parent
    kids = nodes[nodes.parent_id == "root"]
    assert len(kids) >= 2 and kids["n_points"].sum() <= 170  # noise stays at the parent
    assert (nodes.loc["root", ["rel_x", "rel_y"]] == 0).all()
    assert len(t["embedding"]) == len(members) and t["skipped"].empty
    inner = set(nodes[~nodes.is_leaf].index)
    assert set(t["outliers"].node_id) == inner
    assert t["outliers"].outlier_score.between(0, 1).all()


def test_tree_characteristics_use_the_root_scaler(built):
    df, _, t = built
    p, members, c = df.toPandas().set_index("row_id"), t["membership"], t["characteristics"].set_index(["node_id", "feature"])
    for node in members.node_id.unique():
        if node == "root":
            continue
        rows = p.loc[members[members.node_id == node].row_id]
        space = p.loc[members[members.node_id == node.rsplit("/", 1)[0]].row_id]
        z = (rows.a - p.a.mean()) / p.a.std(ddof=0)
        assert np.allclose(c.loc[(node, "a"), ["z_mean", "z_std"]].astype(float), [z.mean(), z.std(ddof=1)])
        sd = space.extra.std(ddof=0)
        want = [(rows.extra.mean() - space.extra.mean()) / sd, rows.extra.std(ddof=0) / sd]
        assert np.allclose(c.loc[(node, "extra"), ["z_mean", "z_std"]].astype(float), want)


def test_scores_are_present_for_every_node(built):
    _, _, t = built
    s = t["scores"]
    assert len(s) == len(t["nodes"]) and s.trustworthiness.between(0, 1).all() and s.cadi.isna().all()


def test_stored_run_is_read_back(spark):
    df = letter_rows(spark, "/root/testdata/sf0.001").select("row_id", *LETTER_COLUMNS[:2])
    store = RunStore(spark, shared_dir(spark) + "/test-runs-" + np.base_repr(np.random.randint(1 << 30), 36))
    config = Config.of(hierarchical_layers=0)
    first, hit = analyse_stored(store, "letters", df, LETTER_COLUMNS[:2], config)
    again, hit2 = analyse_stored(store, "letters", df, LETTER_COLUMNS[:2], config)
    assert (hit, hit2) == (False, True) and first["nodes"].count() == again["nodes"].count() == 1
    assert config.run_key("letters", ["a"]) != Config.of(hierarchical_layers=1).run_key("letters", ["a"])


def test_unknown_settings_are_refused():
    with pytest.raises(ValueError):
        Config.of(hierarchical_layer=2)


def test_describe_selection(spark):
    df = letter_rows(spark, "/root/testdata/sf0.001").withColumn("target_fr", F.col("lang") == "fr")
    node, chosen = df.select("row_id"), df.where("lang = 'fr'").select("row_id")
    out = describe_selection(df, LETTER_COLUMNS, node, chosen, extras=["n_chars"], targets=["target_fr", "target_none"])
    s = out["summary"].head()
    raw = df.toPandas()
    _, _, path, best = brute(raw[LETTER_COLUMNS].to_numpy(), (raw.lang == "fr").to_numpy(), 1.0, "severity")
    assert s.n_selected == chosen.count() and s.n_features_total == len(LETTER_COLUMNS)
    assert s.n_features_used == len(path) and np.isclose(s.predicate_f1, best)
    target = out["targets"].collect()
    assert [r.feature for r in target] == ["target_fr"] and target[0].is_boolean and target[0].sel_mean == 1.0
    assert out["characteristics"].count() == len(LETTER_COLUMNS) + 1
    none = describe_selection(df, LETTER_COLUMNS, node, chosen.limit(0), extras=["n_chars"], targets=["target_fr"])
    assert none.keys() == out.keys() and all(t.columns == out[n].columns and t.isEmpty() for n, t in none.items())
    with pytest.raises(ValueError):
        describe_selection(df, LETTER_COLUMNS, node, node)


def test_principal_axes_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    placed, axes = PR.pca(frame(spark, x), 5)
    got = np.array([r.coordinates for r in placed.orderBy("row_id").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want))
    assert np.allclose(axes.head().explained_variance, values[::-1][:2] / values.sum())


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_distance_scaling(spark, block_rows):
    """Planar rows keep their distances; others settle below the stress of their principal projection, in one block or many."""
    rng = np.random.default_rng(1)
    gap = lambda v: np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    flat = rng.normal(size=(60, 2))
    place = lambda x, **kw: np.array([(r.x, r.y) for r in PR.mds(frame(spark, x), x.shape[1], block_rows=block_rows, **kw).orderBy("row_id").collect()])
    assert np.allclose(gap(place(flat)), gap(flat), atol=1e-6)
    x = rng.normal(size=(50, 6))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    start = (x - x.mean(0)) @ vectors[:, ::-1][:, :2]
    stress = lambda y: ((gap(y) - gap(x)) ** 2).sum() / 2
    first, more = place(x, max_iter=20), place(x, max_iter=20, n_init=2)
    assert stress(first) < 0.8 * stress(start) and stress(more) <= stress(first) + 1e-9
    assert np.allclose(np.abs(place(x, max_iter=0)), np.abs(start))
    with pytest.raises(ValueError):
        PR.mds(frame(spark, x), 6, metric=False)


@pytest.mark.parametrize("parts", [1, 5])
def test_missing_features_count_nowhere(spark, parts):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) + 1e8
    rows = [("n", i, v.tolist()) for i, v in enumerate(x)] + [("n", 90, [1.0, None, 2.0]), ("n", 91, [float("nan"), 0.0, 1.0]), ("n", 92, [float("inf"), 0.0, 1.0]), ("n", 93, None)]
    points = spark.createDataFrame(rows, "node_id string, row_id bigint, features array<double>").repartition(parts)
    placed, axes = PR.pca(points, 3)
    assert axes.head().n_points == 40 and np.allclose(axes.head().center, x.mean(0), rtol=1e-12)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(axes.head().explained_variance, values[:2] / values.sum(), atol=1e-6)
    assert [r.row_id for r in placed.orderBy("row_id").collect()] == list(range(40))


def test_neighbour_graph_weights(spark):
    x = blobs(3, 60, 0)
    fuzzy = PR.fuzzy_graph(frame(spark, x), 8).toPandas()
    assert (fuzzy.a < fuzzy.b).all() and fuzzy.w.between(0, 1 + 1e-9).all()
    # Every row is fully tied to its nearest neighbour.
    top = np.maximum(fuzzy.groupby("a").w.max().reindex(range(60), fill_value=0), fuzzy.groupby("b").w.max().reindex(range(60), fill_value=0))
    assert np.allclose(top, 1.0, atol=1e-6)
    affinity = PR.affinity_graph(frame(spark, x), 5.0).toPandas()
    assert np.isclose(2 * affinity.w.sum(), 1.0)


def test_graph_layout_beats_noise(spark):
    from stratalens.operators import faithfulness as FA

    x = blobs(5, 90, 0)
    points = frame(spark, x).drop("embedding", "label")
    placed, _ = PR.project(points, 3, Config.of(method="UMAP", umap_n_neighbors=10))
    scored = FA.score_nodes(points.join(placed.withColumnRenamed("coordinates", "embedding"), ["node_id", "row_id"]))[0].head()
    assert scored.trustworthiness > 0.85
    solid, _ = PR.project(points, 3, Config.of(layout_epochs=2), 3, "UMAP")
    assert {len(r.coordinates) for r in solid.collect()} == {3}


def test_row_ids_and_draws(spark):
    o = table(spark, "/root/testdata/sf0.001", "orders")
    ids = assign_row_id(o.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], partitions=5).toPandas().sort_values(["o_totalprice", "o_orderkey"])
    assert ids.row_id.tolist() == list(range(len(ids)))
    a = {r[0] for r in subsample(o, 100, 1, "o_orderkey").select("o_orderkey").collect()}
    b = {r[0] for r in subsample(o.repartition(7), 100, 1, "o_orderkey").select("o_orderkey").collect()}
    assert a == b and len(a) == 100
    train, val = train_validation_split(o, 0.25, 3, "o_orderkey")
    assert val.count() == int(o.count() * 0.25) and train.join(val, "o_orderkey").count() == 0


def test_fetch_rows_reports_bad_requests(spark):
    o = table(spark, "/root/testdata/sf0.001", "orders").withColumnRenamed("o_orderkey", "row_id")
    ids = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "position bigint, row_id bigint")
    assert [r.row_id for r in R.fetch_rows(o, ids, ["o_totalprice"]).collect()] == [5, 2, 5]
    assert R.fetch_rows(o, ids, []).columns == ["row_id", "position"] or set(R.fetch_rows(o, ids, []).columns) == {"row_id", "position"}
    with pytest.raises(ValueError):
        R.fetch_rows(o, ids, ["nothing"])
    with pytest.raises(ValueError):
        R.fetch_rows(o, spark.createDataFrame([(0, -9)], "position bigint, row_id bigint"))


def test_no_effective_window_means_no_filtering(spark):
    o = table(spark, "/root/testdata/sf0.001", "orders").withColumnRenamed("o_orderkey", "row_id")
    rows, clauses = R.range_filter(o, {"o_totalprice": (0.0, 1e12)})
    assert clauses == {} and rows.where("matches is not null").count() == 0


def test_column_roles(spark):
    df = spark.createDataFrame([(1, 2.0, True, "x", 3)], "row_id bigint, a double, target_b boolean, name string, c int")
    assert feature_columns(df) == ["a", "c"] and target_columns(df) == ["target_b"]
    assert extra_columns(df, ["a"]) == ["target_b", "c"]


@pytest.mark.parametrize("limit", [5, 10_000])
def test_perturbed_selections_exchange_exactly(spark, limit):
    sel = spark.createDataFrame([("s", i) for i in range(50)], "sel string, row_id bigint")
    pool = spark.createDataFrame([("s", 100 + i) for i in range(30)], "sel string, row_id bigint")
    out = S.perturbed_selections(sel, pool, [0.1, 0.3], 2, limit=limit).toPandas()
    for (delta, _), g in out.groupby(["delta", "rep"]):
        n = round(delta * 50)
        assert len(g) == 50 and (g.row_id < 100).sum() == 50 - n and (g.row_id >= 100).sum() == n
    assert set(out[(out.delta == 0.1) & (out.rep == 0)].row_id) != set(out[(out.delta == 0.1) & (out.rep == 1)].row_id)


@pytest.mark.parametrize("short", [120, 0])
def test_admission_patterns_both_forms(spark, short, monkeypatch):
    monkeypatch.setattr(S, "SHORT_TESTS", short)
    rows = spark.createDataFrame([(float(i), float(i % 3), "s" if i > 5 else None) for i in range(12)], "a double, b double, sel string")
    preds = spark.createDataFrame(
        [("s", 0, "a", 2.0, 8.0, True), ("s", 0, "b", 0.0, 1.0, True), ("s", 1, "a", 4.0, 11.0, True), ("s", 1, "b", 0.0, 0.0, False)],
        "base string, rep int, feature string, sel_min double, sel_max double, active boolean",
    )
    got = S.admission_patterns(rows, ["a", "b"], preds, ["base"], "rep", "sel")
    first = {i for i in range(12) if 2 <= i <= 8 and i % 3 <= 1}
    second = {i for i in range(12) if 4 <= i <= 11}
    assert np.isclose(S.mean_admitted_jaccard(got, ["base"]).head().jaccard_admitted, len(first & second) / len(first | second))
    assert got.agg(F.sum("n")).head()[0] == 12


def test_letters_are_points(spark):
    p = letter_points(spark, "/root/testdata/sf0.001")
    assert p.columns == ["node_id", "row_id", "features"] and p.where(F.size("features") != len(LETTER_COLUMNS)).count() == 0


def test_two_columns_are_settled_without_meeting_pairs(spark, monkeypatch):
    """Principal axes keep the distances of two columns, so no block of pairs is needed, whatever the node's size."""

    def refuse(*args, **kw):
        raise AssertionError("pairs were asked for")

    monkeypatch.setattr(PR, "_settle_large", refuse)
    x = np.random.default_rng(4).normal(size=(60, 2)) * [5.0, 1.0]
    got = PR.mds(frame(spark, x), 2, n_init=2, block_rows=10).orderBy("row_id").collect()
    y = np.array([(r.x, r.y) for r in got])
    apart = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    assert len(got) == 60 and np.allclose(apart(x), apart(y))


def test_two_columns_with_repeated_ids_take_the_rounds(spark):
    x = np.random.default_rng(4).normal(size=(30, 2)) * [5.0, 1.0]
    twice = frame(spark, x).unionByName(frame(spark, x[:7]))
    alone = frame(spark, x).withColumn("node_id", F.lit("alone"))
    got = PR.mds(twice.unionByName(alone), 2).collect()
    assert sum(r.node_id == "alone" for r in got) == 30 and sum(r.node_id == "root" for r in got) == 30 - 7 + 4 * 7
    y = np.array([(r.x, r.y) for r in got if r.node_id == "root"])
    assert np.allclose(y.mean(axis=0), 0)
