"""Clustering, projections and whole analyses. Documents as points of letter shares fall into
their languages; lineitem gives two-column projections whose axes have a closed form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Config
from ..operators import characteristics as CH
from ..operators import clustering as C
from ..operators import density as D
from ..operators import faithfulness as FA
from ..operators import projection as PR
from ..operators import trees as TR
from ..plans import analyse as A
from ..plans import sweep as SW
from ..session import hold, shared_dir
from ..sources.runs import RunStore
from . import query
from .inputs import LETTER_COLUMNS, LETTER_SQL, LETTERS, letter_points, letter_rows, lines, rounded, vectors

DIMS = len(LETTERS)
TREE = Config.of(hierarchical_layers=2, hclust_min_cluster_size=25, hclust_min_samples=5, hclust_umap_n_components=0)


def label_sizes(labels):
    return labels.groupBy("node_id", "label").agg(F.count("*").alias("n"))


@query("k1_kmeans")
def k1(spark, sf):
    return C.kmeans(letter_points(spark, sf), 4).select("row_id", "label")


@query("k2_gaussian_mixture")
def k2(spark, sf):
    return C.gaussian_mixture(letter_points(spark, sf), 4).select("row_id", "label")


# Customers of a segment in two far groups, by the parity of their nation: every node finds its own two.
_PLANTED_SQL = """select c_mktsegment as node_id, c_nationkey % 2 as side, count(*) as n, cast(1 as bigint) as n_labels,
                  cast(2 as bigint) as n_clusters from customer group by 1, 2"""


def planted(spark, sf):
    from .inputs import table

    c = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("node_id"), F.col("c_custkey").alias("row_id"), F.col("c_acctbal"), (F.col("c_nationkey") % 2).alias("side"), F.ascii("c_mktsegment").cast("double").alias("far")
    )
    return c.select("node_id", "row_id", "side", F.array(F.col("c_acctbal") / 10_000, F.col("side") * 100.0 + 1000 * F.col("far")).alias("features"))


def planted_labels(points, found):
    both = points.join(found, ["node_id", "row_id"])
    clusters = both.groupBy("node_id").agg(F.count_distinct("label").alias("n_clusters"))
    sides = both.groupBy("node_id", "side").agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"))
    return sides.join(clusters, "node_id").select("node_id", "side", "n", "n_labels", "n_clusters")


@query("k1_planted_nodes", _PLANTED_SQL)
def k1_planted(spark, sf):
    p = planted(spark, sf)
    return planted_labels(p, C.kmeans(p, 2))


@query("k2_planted_nodes", _PLANTED_SQL)
def k2_planted(spark, sf):
    p = planted(spark, sf)
    return planted_labels(p, C.gaussian_mixture(p, 2))


@query("k12_planted_groups", _PLANTED_SQL.replace("cast(2 as bigint)", "(select count(distinct c_mktsegment || (c_nationkey % 2)) from customer)"))
def k12_planted(spark, sf):
    p = planted(spark, sf)
    config = Config.of(cluster_method="KMeans", cluster_n_clusters=2)
    found = C.cluster_within_groups(p.withColumn("segment", F.col("node_id")), "segment", config)
    both = p.join(found, "row_id")
    sides = both.groupBy("node_id", "side").agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"))
    return sides.crossJoin(F.broadcast(found.agg(F.count_distinct("label").alias("n_clusters"))))


@query(
    "k3_dbscan",
    f"""with recursive {LETTER_SQL},
        near as materialized (select a.row_id as i, b.row_id as j from letters a join letters b on list_distance(a.v, b.v) <= 1.0),
        core as materialized (select i from near group by i having count(*) >= 10),
        links as materialized (select n.i, n.j from near n join core a on n.i = a.i join core b on n.j = b.i),
        reach(i, root) as (select i, i from core union select l.j, r.root from reach r join links l on l.i = r.i and r.root < l.j),
        comp as (select i, min(root) as c from reach group by 1),
        num as (select c, cast(row_number() over (order by c) - 1 as int) as label from (select distinct c from comp)),
        cl as (select i, label from comp join num using (c)),
        edge as (select n.i, min(label) as label from near n join cl on cl.i = n.j where n.i not in (select i from core) group by 1)
        select row_id, coalesce(cl.label, edge.label, -1) as label from letters left join cl on cl.i = row_id left join edge on edge.i = row_id""",
)
def k3(spark, sf):
    return D.dbscan(letter_points(spark, sf), 1.0, 10).select("row_id", "label")


@query("k4_hdbscan")
def k4(spark, sf):
    return D.hdbscan(letter_points(spark, sf), 25, 5).select("row_id", "label")


def planted_lattice(spark, sf):
    """Every segment's customers as two rows of evenly spaced points far apart, by the parity of their nation."""
    place = F.row_number().over(Window.partitionBy("node_id", "side").orderBy("row_id")).cast("double")
    return planted(spark, sf).select("node_id", "row_id", "side", F.array(place, F.col("side") * 1e6).alias("features"))


# Evenly spaced points never split before they part altogether, so a segment has its two sides and no noise.
@query("k4_planted_nodes", _PLANTED_SQL)
def k4_planted(spark, sf):
    p = hold(planted_lattice(spark, sf))
    return planted_labels(p, D.hdbscan(p, 5, 3).select("node_id", "row_id", "label"))


@query("k5_outlier_scores")
def k5(spark, sf):
    return rounded(D.hdbscan(letter_points(spark, sf), 25, 5).select("row_id", "outlier_score"))


def stored(spark, sf):
    """The document tree, built once per application and data folder and read back by the queries on it."""
    app = spark.sparkContext.applicationId
    store = RunStore(spark, f"{shared_dir(spark).rstrip('/')}/stratalens-runs/{app}")
    return A.analyse_stored(store, sf, letter_rows(spark, sf).drop("lang", "source"), LETTER_COLUMNS, TREE, ["n_chars"])[0]


@query("k6_build_tree")
def k6(spark, sf):
    return rounded(stored(spark, sf)["nodes"].drop("explained_variance"))


@query("k6_membership")
def k6m(spark, sf):
    return stored(spark, sf)["membership"]


@query("k6_characteristics")
def k6c(spark, sf):
    return rounded(stored(spark, sf)["characteristics"])


@query("k6_scores")
def k6s(spark, sf):
    return rounded(stored(spark, sf)["scores"])


@query("k6_outliers")
def k6o(spark, sf):
    return rounded(stored(spark, sf)["outliers"])


@query("k7_pre_reduction")
def k7(spark, sf):
    p = hold(letter_points(spark, sf))
    space, dims = A.clustering_space(p, DIMS, p.count(), Config.of(hclust_umap_n_components=3))
    return rounded(space.select("row_id", *[F.col("features")[i].alias(f"c{i}") for i in range(dims)]))


@query("k8_sibling_layout")
def k8(spark, sf):
    v = vectors(spark, sf).select(F.lit("root").alias("node_id"), F.col("label").alias("cluster"), "features")
    return rounded(PR.sibling_layout(CH.centroids(v, "features", 64, ["node_id", "cluster"]), 64))


# Three centroids always fit into the plane, so the layout keeps their distances exactly.
@query(
    "k8_three_children",
    """with cells as (select (vec_id % 5)::varchar as node_id, (label % 3)::int as child, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
       centre as (select node_id, child, i, avg(v) as v from cells group by all)
       select a.node_id, a.child as first, b.child as second, round(sqrt(sum((a.v - b.v) ** 2)), 4) as distance
       from centre a join centre b on a.node_id = b.node_id and a.i = b.i and a.child < b.child group by 1, 2, 3""",
)
def k8_three(spark, sf):
    v = vectors(spark, sf).select((F.col("row_id") % 5).cast("string").alias("node_id"), (F.col("label") % 3).cast("int").alias("cluster"), "features")
    placed = hold(PR.sibling_layout(CH.centroids(v, "features", 64, ["node_id", "cluster"]), 64))
    side = lambda name: placed.select("node_id", F.col("cluster").alias(name), F.struct("rel_x", "rel_y").alias(f"p_{name}"))
    both = side("first").join(side("second"), "node_id").where("first < second")
    apart = F.hypot(F.col("p_first.rel_x") - F.col("p_second.rel_x"), F.col("p_first.rel_y") - F.col("p_second.rel_y"))
    return rounded(both.select("node_id", "first", "second", apart.alias("distance")), 4)


@query("k12_cluster_within_groups")
def k12(spark, sf):
    config = Config.of(hclust_min_cluster_size=10, hclust_min_samples=5)
    return C.cluster_within_groups(letter_points(spark, sf, "lang"), "lang", config)


@query("k13_reduce_then_cluster")
def k13(spark, sf):
    config = Config.of(method="PCA", cluster_method="DBSCAN", dbscan_eps=0.5, hclust_min_samples=10)
    return SW.reduce_then_cluster(letter_points(spark, sf), DIMS, config).select("row_id", "label")


# The planted sides in four columns, reduced to three.
@query("k13_planted_nodes", _PLANTED_SQL)
def k13_planted(spark, sf):
    p = planted(spark, sf)
    more = [F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(1000)) / 1000.0 for seed in (1, 2)]
    p = hold(p.withColumn("features", F.concat("features", F.array(*more))))
    return planted_labels(p, SW.reduce_then_cluster(p.drop("side"), 4, Config.of(method="PCA", cluster_method="KMeans", cluster_n_clusters=2), 3))


# Two columns: the covariance matrix [[p, q], [q, r]] has its first axis along (q, l - p).
@query(
    "e1_two_column_axes",
    """with m as (select l_returnflag as node_id, avg(l_quantity) as mx, avg(y) as my, var_samp(l_quantity) as p, covar_samp(l_quantity, y) as q, var_samp(y) as r
          from (select *, l_extendedprice / 2000 as y from lineitem) group by 1),
        e as (select *, (p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q) as l from m),
        a as (select *, q / sqrt(q * q + (l - p) ** 2) as ax, (l - p) / sqrt(q * q + (l - p) ** 2) as ay from e),
        s as (select *, case when abs(ax) >= abs(ay) then sign(ax) else sign(ay) end as f, case when abs(ay) >= abs(ax) then sign(-ay) else sign(ax) end as g from a)
        select node_id, l_orderkey, l_linenumber, round(f * (ax * (l_quantity - mx) + ay * (l_extendedprice / 2000 - my)), 5) as x,
          round(g * (-ay * (l_quantity - mx) + ax * (l_extendedprice / 2000 - my)), 5) as y, round(l / (p + r), 6) as share
        from lineitem join s on node_id = l_returnflag""",
)
def e1(spark, sf):
    points = line_plane(spark, sf)
    axes = hold(PR.principal_axes(points, 2))
    placed = points.join(axes, "node_id")
    out = placed.select(
        "node_id", "l_orderkey", "l_linenumber", F.round(PR._along(F.col("axes")[0]), 5).alias("x") + 0.0, F.round(PR._along(F.col("axes")[1]), 5).alias("y") + 0.0,
        F.round(F.col("explained_variance")[0], 6).alias("share"),
    )
    return out.toDF("node_id", "l_orderkey", "l_linenumber", "x", "y", "share")


def line_plane(spark, sf):
    """lineitem as points of two columns, a node per return flag."""
    src = lines(spark, sf).withColumn("row_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return src.select(F.col("l_returnflag").alias("node_id"), "row_id", F.array(F.col("l_quantity"), F.col("l_extendedprice") / 2000).alias("features"), "l_orderkey", "l_linenumber")


# Distances of two columns are kept exactly by their principal coordinates, so scaling stops there.
@query(
    "e2_two_column_scaling",
    """with p as (select o_orderpriority as node_id, o_orderkey, o_totalprice / 1000 as x1, cast(o_custkey as double) / 10 as x2 from orders),
        m as (select node_id, avg(x1) as mx, avg(x2) as my, var_samp(x1) as p, covar_samp(x1, x2) as q, var_samp(x2) as r from p group by 1),
        e as (select *, (p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q) as l from m),
        a as (select *, q / sqrt(q * q + (l - p) ** 2) as ax, (l - p) / sqrt(q * q + (l - p) ** 2) as ay from e),
        s as (select *, case when abs(ax) >= abs(ay) then sign(ax) else sign(ay) end as f, case when abs(ay) >= abs(ax) then sign(-ay) else sign(ax) end as g from a)
        select node_id, o_orderkey, round(f * (ax * (x1 - mx) + ay * (x2 - my)), 5) as x, round(g * (-ay * (x1 - mx) + ax * (x2 - my)), 5) as y
        from p join s using (node_id)""",
)
def e2_plane(spark, sf):
    from .inputs import table

    o = table(spark, sf, "orders")
    points = o.select(F.col("o_orderpriority").alias("node_id"), F.col("o_orderkey").alias("row_id"), F.array(F.col("o_totalprice") / 1000, F.col("o_custkey").cast("double") / 10).alias("features"))
    placed = PR.mds(points, 2, n_init=1)
    return rounded(placed.select("node_id", F.col("row_id").alias("o_orderkey"), "x", "y"), 5)


def projected(spark, sf, config):
    p = letter_points(spark, sf)
    placed, _ = PR.project(p, DIMS, config)
    return rounded(PR.as_xy(placed).select("row_id", "x", "y"))


@query("e1_principal_axes")
def e1b(spark, sf):
    return projected(spark, sf, Config.of(method="PCA"))


@query("e2_distance_scaling")
def e2(spark, sf):
    return projected(spark, sf, Config.of(method="MDS"))


@query("e3_affinity_graph")
def e3(spark, sf):
    return rounded(PR.affinity_graph(letter_points(spark, sf), 10.0), 9)


@query("e4_fuzzy_graph")
def e4(spark, sf):
    return rounded(PR.fuzzy_graph(letter_points(spark, sf), 15), 9)


@query("e5_graph_layout")
def e5(spark, sf):
    return projected(spark, sf, Config.of(method="UMAP"))


@query(
    "e6_projection_guard",
    """with m as (select 'root' as node_id, c_custkey as row_id from customer
          union all select 'root/' || (cast(floor(c_acctbal / 5) as int)), c_custkey from customer), s as (select node_id, count(*) as n from m group by 1)
       select node_id, n < 2 as skipped, case when n >= 2 then n else 0 end as n_embedded from s""",
)
def e6(spark, sf):
    from .inputs import table

    c = table(spark, sf, "customer")
    nodes = F.array(F.lit("root"), F.concat(F.lit("root/"), F.floor(F.col("c_acctbal") / 5).cast("int").cast("string")))
    members = c.select(F.explode(nodes).alias("node_id"), F.col("c_custkey").alias("row_id"))
    points = c.select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("features"))
    embedding, _, skipped = A.node_projections(points, members, 2, Config())
    counts = embedding.where(F.col("x").isNotNull()).groupBy("node_id").agg(F.count("*").alias("n_embedded"))
    names = members.select("node_id").distinct()
    out = names.join(counts, "node_id", "left").join(skipped.select("node_id", F.lit(True).alias("s")), "node_id", "left")
    return out.select("node_id", F.coalesce("s", F.lit(False)).alias("skipped"), F.coalesce("n_embedded", F.lit(0)).alias("n_embedded"))


@query("v11_density_validity")
def v11(spark, sf):
    rows = letter_points(spark, sf, "lang").withColumn("label", F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")).cast("int") - 1)
    in_space = rows.withColumn("node_id", F.lit("original"))
    placed, _ = PR.pca(rows, DIMS, 2)
    in_view = rows.drop("features").join(placed, ["node_id", "row_id"]).select(F.lit("embedded").alias("node_id"), "row_id", F.col("coordinates").alias("features"), "lang", "label")
    return rounded(D.density_validity(in_space.unionByName(in_view)))


# Neighbouring customers of one segment are a cluster of two: its core distance and the only edge of its tree
# are the distance of the two. All others are alone, which is noise.
PAIRS_SQL = """c as (select c_mktsegment as node_id, c_custkey as row_id, c_acctbal::double as x, c_nationkey * 100.0::double as y,
         c_custkey // 2 as label from customer),
       n_all as (select node_id, count(*) as n_all from c group by 1),
       d as materialized (select a.node_id, a.label as la, b.label as lb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from c a join c b on a.node_id = b.node_id and a.row_id <> b.row_id),
       core as (select node_id, la as label, max(d) as core from d where la = lb group by all),
       sep as (select d.node_id, la as label, min(greatest(d, p.core, q.core)) as sep from d join core p on p.node_id = d.node_id and p.label = la join core q on q.node_id = d.node_id and q.label = lb where la <> lb group by all)"""


@query(
    "v11_clusters_of_two",
    f"""with {PAIRS_SQL} select node_id, round(sum(2.0::double / n_all * (sep - core) / greatest(sep, core)), 6) as dbcv, count(*) as n_clusters
        from core join sep using (node_id, label) join n_all using (node_id) group by 1""",
)
def v11_pairs(spark, sf):
    from .inputs import table

    c = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("node_id"), F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey") * F.lit(100.0)).alias("features"),
        F.floor(F.col("c_custkey") / 2).cast("int").alias("label"),
    )
    return rounded(D.density_validity(c).select("node_id", "dbcv", F.col("n_clusters").cast("bigint").alias("n_clusters")))


@query("t32_configuration_sweep")
def t32(spark, sf):
    configs = [
        Config.of(method="PCA", cluster_method="KMeans", cluster_n_clusters=4),
        Config.of(method="PCA", cluster_method="DBSCAN", dbscan_eps=0.5, hclust_min_samples=10),
        Config.of(method="MDS", cluster_method="GMM", gmm_n_components=4),
    ]
    points = hold(letter_points(spark, sf))
    truth = letter_rows(spark, sf).select("row_id", F.col("lang").alias("truth"))
    return rounded(SW.sweep(points, DIMS, configs, truth))


@query("r15_rule_tree")
def r15(spark, sf):
    src = lines(spark, sf).withColumn("inside", (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05))
    text = C.rule_tree(src, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "inside")
    rows = src.agg(F.count_if("inside").alias("n_inside"), F.count("*").alias("n_rows"))
    return rows.withColumn("rules", F.lit(text))
