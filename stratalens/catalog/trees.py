"""Tree tables over orders: status is the first layer, priority the second (see inputs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees as T
from . import query
from .inputs import ORDER_TREE_SQL, order_membership, order_rows, rounded, table

NODES_SQL = f"""{ORDER_TREE_SQL}, sizes as (select node_id, count(*) as n_points from membership group by 1),
  nodes as (select node_id, case when node_id <> 'root' then regexp_extract(node_id, '^(.*)/[^/]+$', 1) end as parent_id,
      cast(len(string_split(node_id, '/')) - 1 as int) as depth,
      case when node_id <> 'root' then cast(regexp_extract(node_id, '([^/]+)$', 1) as int) end as child_ix,
      node_id not in (select regexp_extract(node_id, '^(.*)/[^/]+$', 1) from sizes) as is_leaf, n_points from sizes)"""


def tree(spark, sf):
    rows = order_rows(spark, sf)
    members = order_membership(rows)
    return rows, members, T.nodes_from_membership(members)


@query("a15_node_table", f"with {NODES_SQL} select node_id, parent_id, depth, child_ix, is_leaf, n_points from nodes")
def a15(spark, sf):
    return tree(spark, sf)[2]


@query("p7_node_at_path", f"with {NODES_SQL} select 'root/1/2/0/3' as path, node_id, n_points from nodes where node_id = 'root/1/2'")
def p7(spark, sf):
    return T.node_at(tree(spark, sf)[2], "root/1/2/0/3").select(F.lit("root/1/2/0/3").alias("path"), "node_id", "n_points")


@query("p8_whole_layer", f"with {ORDER_TREE_SQL} select row_id, c2 = -1 as is_noise from tree_rows where c1 = 1")
def p8(spark, sf):
    rows, members, _ = tree(spark, sf)
    return T.layer(members, "root/1").join(rows.select("row_id", "c2"), "row_id").select("row_id", (F.col("c2") == -1).alias("is_noise"))


@query(
    "a14_layer_census",
    f"""with {ORDER_TREE_SQL} select 'root' as node_id, case when c1 >= 0 then 'root/' || c1 end as child_id, count(*) as n from tree_rows group by 1, 2
        union all select 'root/' || c1, case when c2 >= 0 then 'root/' || c1 || '/' || c2 end, count(*) from tree_rows where c1 >= 0 group by 1, 2""",
)
def a14(spark, sf):
    _, members, nodes = tree(spark, sf)
    return T.layer_census(nodes, members)


@query("a16_tree_counts", f"with {NODES_SQL} select cast(count_if(not is_leaf) as bigint) as n_inner, cast(count_if(is_leaf) as bigint) as n_leaves from nodes")
def a16(spark, sf):
    return T.tree_counts(tree(spark, sf)[2])


# Builds: one tree per order year, leaves are (status, priority). The share of expensive
# orders stands in for a score that is missing where the leaf is small.
BUILD_SQL = """b as (select extract(year from o_orderdate) as build, o_orderkey as row_id,
     'root/' || o_orderstatus || '/' || substr(o_orderpriority, 1, 1) as leaf, o_totalprice, o_orderpriority <> '5-LOW' as kept from orders),
  leaves as (select build, leaf as node_id, count(*) as n_points, case when count(*) % 3 > 0 then avg(o_totalprice / 500000) end as trustworthiness,
     case when count(*) % 2 > 0 then avg(o_totalprice / 400000) end as continuity, count(*) % 5 > 0 as projected from b where kept group by 1, 2)"""


def builds(spark, sf):
    """(nodes, scores) of one small tree per order year."""
    o = table(spark, sf, "orders").withColumn("build", F.year("o_orderdate"))
    leaf = F.concat_ws("/", F.lit("root"), "o_orderstatus", F.substring("o_orderpriority", 1, 1))
    leaves = (
        o.where(F.col("o_orderpriority") != "5-LOW")
        .groupBy("build", leaf.alias("node_id"))
        .agg(F.count("*").alias("n_points"), F.avg(F.col("o_totalprice") / 500000).alias("tw"), F.avg(F.col("o_totalprice") / 400000).alias("co"))
    )
    n = F.col("n_points")
    scores = leaves.select("build", "node_id", "n_points", F.when(n % 3 > 0, F.col("tw")).alias("trustworthiness"), F.when(n % 2 > 0, F.col("co")).alias("continuity"))
    nodes = leaves.select("build", "node_id", F.lit(2).alias("depth"), F.lit(True).alias("is_leaf"), "n_points", (n % 5 > 0).alias("projected"))
    root = o.groupBy("build").agg(F.count("*").alias("n_points")).select(
        "build", F.lit("root").alias("node_id"), F.lit(0).alias("depth"), F.lit(False).alias("is_leaf"), "n_points", F.lit(True).alias("projected")
    )
    return nodes.unionByName(root), scores


@query(
    "a17_tree_shape",
    f"""with {BUILD_SQL}, r as (select build, count(*) as n_rows from b group by 1)
        select cast(build as int) as build, any_value(n_rows) as n_rows, 2 as realized_depth, true as cap_censored, count(*) as n_leaves,
        quantile_cont(n_points, 0.5) as median_leaf_size, min(n_points) as min_leaf_size, max(n_points) as max_leaf_size,
        round(1.0 - sum(n_points)::double / any_value(n_rows), 6) as noise_fraction, count(trustworthiness) as n_leaves_scored,
        cast(count_if(n_points >= 20) as bigint) as n_leaves_predicated, cast(count_if(not projected) as bigint) as n_leaves_unprojected, false as root_unprojected
        from leaves join r using (build) group by build""",
)
def a17(spark, sf):
    nodes, scores = builds(spark, sf)
    return rounded(T.tree_shape(nodes, scores, ["build"], depth_cap=2))


@query(
    "a18_leaf_purity",
    """with t as (select year(o_orderdate) as build, case when o_orderpriority <> '5-LOW' then o_orderpriority end as leaf_id,
          cast(floor(o_totalprice / 100000) as int) as class_id from orders),
        c as (select build, leaf_id, class_id, count(*) as n from t group by all),
        w as (select build, class_id, sum(n) as class_n from c group by all), r as (select build, sum(n) as n_rows from c group by all),
        top as (select * from (select *, sum(n) over (partition by build, leaf_id) as leaf_n,
            row_number() over (partition by build, leaf_id order by n desc, class_id) as rn from c where leaf_id is not null) where rn = 1)
        select cast(build as int) as build, leaf_id, cast(leaf_n as bigint) as leaf_n, class_id as majority_class, round(n::double / leaf_n, 6) as purity,
          round(class_n::double / n_rows, 6) as global_share, round((n::double / leaf_n) / (class_n::double / n_rows), 6) as enrichment
        from top join w using (build, class_id) join r using (build)""",
)
def a18(spark, sf):
    o = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("build"), F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("leaf_id"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("class_id"),
    )
    return rounded(T.leaf_purity(o, ["build"]))


def mean_sql(c: str) -> str:
    return f"round(avg({c}), 6) as {c}_mean, round(sum({c} * n_points) / sum(case when {c} is not null then n_points end), 6) as {c}_wmean"


@query(
    "a19_leaf_means",
    f"with {BUILD_SQL} select cast(build as int) as build, count(trustworthiness) as n_leaves_scored, {mean_sql('trustworthiness')}, {mean_sql('continuity')} from leaves group by 1",
)
def a19(spark, sf):
    return rounded(T.leaf_means(builds(spark, sf)[1], ["trustworthiness", "continuity"], ["build"]))


@query(
    "a20_median_range",
    "select event_type, round(quantile_cont(value, 0.5), 6) as median, min(value) as lowest, max(value) as highest from events group by 1",
)
def a20(spark, sf):
    return rounded(T.median_range(table(spark, sf, "events"), "value", ["event_type"]))


@query(
    "a21_two_stage_median",
    """with i as (select event_type, user_id, quantile_cont(value, 0.5) as m from events group by all)
       select event_type, median, count, s as median_of_stage_medians from
       (select event_type, round(quantile_cont(value, 0.5), 6) as median, count(value) as count from events group by 1)
       join (select event_type, round(quantile_cont(m, 0.5), 6) as s from i group by 1) using (event_type)""",
)
def a21(spark, sf):
    return rounded(T.two_stage_median(table(spark, sf, "events"), "value", ["event_type"], ["user_id"]))


@query(
    "a22_cluster_stats",
    """select n_clusters, round(noise, 6) as noise_fraction, lang from (select lang, count(distinct case when label >= 0 then label end) as n_clusters,
        avg(case when label = -1 then 1.0 else 0.0 end) as noise from (select lang, case when n_chars < 300 then -1 else cast(n_chars // 1000 as int) end as label from documents) group by lang)""",
)
def a22(spark, sf):
    label = F.when(F.col("n_chars") < 300, -1).otherwise(F.floor(F.col("n_chars") / 1000).cast("int"))
    return rounded(T.cluster_stats(table(spark, sf, "documents").select("lang", label.alias("label")), ["lang"]))


@query(
    "a23_grouped_medians",
    """select l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.5) as l_quantity, round(quantile_cont(l_extendedprice, 0.5), 6) as l_extendedprice,
       quantile_cont(l_discount, 0.5) as l_discount, count(*) as n_selections from lineitem group by 1, 2""",
)
def a23(spark, sf):
    return rounded(T.grouped_medians(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]))


LEAF_SQL = f"{NODES_SQL}, leaf as (select node_id, cast(row_number() over (order by node_id) - 1 as int) as label from nodes where is_leaf)"


@query(
    "k9_leaf_partition",
    f"""with {LEAF_SQL} select t.row_id, coalesce(label, -1) as label from tree_rows t left join
        (select m.row_id, label from membership m join leaf using (node_id)) x using (row_id)""",
)
def k9(spark, sf):
    rows, members, nodes = tree(spark, sf)
    return T.leaf_partition(nodes, members, rows)


@query("k10_depth_one_partition", f"with {ORDER_TREE_SQL} select row_id, cast(c1 as int) as label from tree_rows")
def k10(spark, sf):
    rows, members, nodes = tree(spark, sf)
    return T.depth_one_partition(nodes, members, rows)


@query(
    "k11_child_labels",
    f"with {ORDER_TREE_SQL} select 'root' as node_id, row_id, cast(c1 as int) as label from tree_rows union all select 'root/' || c1, row_id, c2 from tree_rows where c1 >= 0",
)
def k11(spark, sf):
    _, members, nodes = tree(spark, sf)
    return T.child_labels(nodes, members)


@query(
    "g8_neighbourhood_size",
    """select user_id, n, case when n >= 10 and least(20, (n - 1) // 2) >= 1 then cast(least(20, (n - 1) // 2) as int) end as k,
       case when n >= 21 then 10 end as k_fixed from (select user_id, count(*) as n from events group by 1)""",
)
def g8(spark, sf):
    sizes = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return sizes.select("user_id", "n", T.scoring_k(F.col("n")).alias("k"), T.fixed_k(F.col("n")).alias("k_fixed"))


@query(
    "g13_faithfulness_mean",
    f"""with {BUILD_SQL} select cast(build as int) as build, round(avg((trustworthiness + continuity) / 2), 6) as tnc_mean,
        count((trustworthiness + continuity)) as n_scored_nodes,
        round(coalesce(sum(case when trustworthiness + continuity is not null then n_points end)::double / sum(n_points), 0), 6) as scored_coverage from leaves group by 1""",
)
def g13(spark, sf):
    nodes, scores = builds(spark, sf)
    return rounded(T.faithfulness_mean(scores, nodes, ["build"]))
