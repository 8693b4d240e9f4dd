"""Operators on the tree tables: nodes(node_id, parent_id, depth, child_ix, is_leaf, ...) and
membership(node_id, row_id). Noise rows belong to a parent and to none of its children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import medians, with_medians

SCORE_FLOOR_K = 10
MIN_SCORE_ROWS = 2 * SCORE_FLOOR_K + 1
EVAL_K = 20
MIN_ROWS_FOR_K = 10


def path_order() -> Column:
    """Sort key that visits paths depth first, children by index ("root/2" before "root/10")."""
    return F.transform(F.split(F.substring(F.col("node_id"), 6, 1 << 20), "/"), lambda p: F.lpad(p, 12, "0"))


def nodes_from_membership(membership: DataFrame) -> DataFrame:
    """The node table implied by path ids: parent, depth, child index, size, leaf flag."""
    sizes = membership.groupBy("node_id").agg(F.count("*").alias("n_points"))
    out = sizes.select(
        "node_id",
        F.when(F.col("node_id") != "root", F.regexp_extract("node_id", "^(.*)/[^/]+$", 1)).alias("parent_id"),
        (F.size(F.split("node_id", "/")) - 1).alias("depth"),
        F.when(F.col("node_id") != "root", F.regexp_extract("node_id", "([^/]+)$", 1).cast("int")).alias("child_ix"),
        "n_points",
    )
    parents = out.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("node_id"), F.lit(False).alias("leaf")).distinct()
    return out.join(parents, "node_id", "left").select(
        "node_id", "parent_id", "depth", "child_ix", F.coalesce("leaf", F.lit(True)).alias("is_leaf"), "n_points"
    )


def node_at(nodes: DataFrame, path: str) -> DataFrame:
    """The node of a path; a path that runs past a leaf stops there."""
    steps = path.split("/")
    prefixes = ["/".join(steps[: i + 1]) for i in range(len(steps))]
    return nodes.where(F.col("node_id").isin(prefixes)).orderBy(F.col("depth").desc()).limit(1)


def layer(membership: DataFrame, node_id: str) -> DataFrame:
    """All rows of a node, those that fell out of its children included."""
    return membership.where(F.col("node_id") == node_id)


def layer_census(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node_id, child_id, n) per inner node; ``child_id`` null counts the noise rows."""
    sizes = nodes.where(~F.col("is_leaf")).select("node_id", "n_points")
    children = nodes.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), F.col("n_points").alias("n")
    )
    placed = children.groupBy("node_id").agg(F.sum("n").alias("placed"))
    noise = sizes.join(placed, "node_id").select("node_id", F.lit(None).cast("string").alias("child_id"), (F.col("n_points") - F.col("placed")).alias("n"))
    return children.unionByName(noise)


def tree_counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if(~F.col("is_leaf")).alias("n_inner"), F.count_if("is_leaf").alias("n_leaves"))


def tree_shape(nodes: DataFrame, scores: DataFrame, by: Sequence[str], depth_cap: int, min_selection: int = 20) -> DataFrame:
    """One row per build: depth, leaf sizes, noise share, scored, eligible and unprojected leaves.

    ``nodes`` carries ``by`` and ``projected``; ``scores`` carries ``by`` and node ids.
    """
    keys = list(by)
    leaf = F.col("is_leaf")
    size = F.when(leaf, F.col("n_points"))
    joined = nodes.join(scores.select(*keys, "node_id", "trustworthiness"), [*keys, "node_id"], "left")
    total = F.max(F.when(F.col("node_id") == "root", F.col("n_points")))
    shapes = joined.groupBy(*keys).agg(
        total.alias("n_rows"),
        F.max(F.when(leaf, F.col("depth"))).alias("realized_depth"),
        (F.max(F.when(leaf, F.col("depth"))) >= depth_cap).alias("cap_censored"),
        F.count_if(leaf).alias("n_leaves"),
        F.min(size).alias("min_leaf_size"),
        F.max(size).alias("max_leaf_size"),
        (F.lit(1.0) - F.sum(size) / total).alias("noise_fraction"),
        F.count_if(leaf & F.col("trustworthiness").isNotNull()).alias("n_leaves_scored"),
        F.count_if(leaf & (F.col("n_points") >= min_selection)).alias("n_leaves_predicated"),
        F.count_if(leaf & ~F.col("projected")).alias("n_leaves_unprojected"),
        F.bool_or((F.col("node_id") == "root") & ~F.col("projected")).alias("root_unprojected"),
    )
    return with_medians(shapes, joined, keys, {"median_leaf_size": size})


def leaf_purity(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., leaf_id, majority_class, purity, global_share, enrichment).

    ``leaves`` holds (by..., row_id, leaf_id or null, class_id) for every row. Ties go to
    the lowest class.
    """
    keys = list(by)
    counts = leaves.groupBy(*keys, "leaf_id", "class_id").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*keys, "class_id").agg(F.sum("n").alias("class_n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n_rows")) if keys else counts.agg(F.sum("n").alias("n_rows"))
    order = Window.partitionBy(*keys, "leaf_id").orderBy(F.col("n").desc(), "class_id")
    leaf_n = F.sum("n").over(Window.partitionBy(*keys, "leaf_id"))
    top = counts.where(F.col("leaf_id").isNotNull()).withColumns({"leaf_n": leaf_n, "rn": F.row_number().over(order)}).where("rn = 1")
    joined = top.join(whole, [*keys, "class_id"])
    joined = joined.join(total, keys) if keys else joined.join(F.broadcast(total))
    purity, share = F.col("n") / F.col("leaf_n"), F.col("class_n") / F.col("n_rows")
    return joined.select(
        *keys, "leaf_id", "leaf_n", F.col("class_id").alias("majority_class"), purity.alias("purity"),
        share.alias("global_share"), (purity / share).alias("enrichment"),
    )


def leaf_means(scores: DataFrame, columns: Sequence[str], by: Sequence[str], weight: str = "n_points") -> DataFrame:
    """Mean over leaves, plain and weighted by size; nulls leave their column only."""
    out = []
    for c in columns:
        have = F.when(F.col(c).isNotNull(), F.col(weight))
        out += [F.avg(c).alias(f"{c}_mean"), (F.sum(F.col(c) * F.col(weight)) / F.sum(have)).alias(f"{c}_wmean")]
    return scores.groupBy(*by).agg(F.count(columns[0]).alias("n_leaves_scored"), *out)


def median_range(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    ends = df.groupBy(*by).agg(F.min(column).cast("double").alias("lowest"), F.max(column).cast("double").alias("highest"))
    return with_medians(ends, df, by, {"median": column}).select(*by, "median", "lowest", "highest")


def two_stage_median(df: DataFrame, column: str, by: Sequence[str], stage: Sequence[str]) -> DataFrame:
    """Pooled median beside the median of the medians per stage."""
    pooled = with_medians(df.groupBy(*by).agg(F.count(column).alias("count")), df, by, {"median": column})
    inner = medians(df, [*by, *stage], {"m": column})
    return with_medians(pooled, inner, by, {"median_of_stage_medians": "m"}).select(*by, "median", "count", "median_of_stage_medians")


def grouped_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str], size_name: str = "n_selections") -> DataFrame:
    sizes = df.groupBy(*by).agg(F.count("*").alias(size_name))
    return with_medians(sizes, df, by, {c: c for c in columns}).select(*by, *columns, size_name)


def cluster_stats(partition: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clusters without noise, and the noise share."""
    return partition.groupBy(*by).agg(
        F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"),
        F.avg((F.col("label") == -1).cast("double")).alias("noise_fraction"),
    )


def leaf_numbers(nodes: DataFrame) -> DataFrame:
    """(node_id, leaf_no): leaves counted depth first. One row per leaf, so one sort of them."""
    return nodes.where("is_leaf").select("node_id", (F.row_number().over(Window.orderBy(path_order())) - 1).alias("leaf_no"))


def leaf_partition(nodes: DataFrame, membership: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, label): number of the leaf, -1 for rows in none."""
    inside = membership.join(leaf_numbers(nodes), "node_id").select("row_id", "leaf_no")
    return rows.select("row_id").join(inside, "row_id", "left").select("row_id", F.coalesce("leaf_no", F.lit(-1)).alias("label"))


def depth_one_partition(nodes: DataFrame, membership: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, label): child of the root; a tree of a single leaf is one cluster 0."""
    first = nodes.where((F.col("depth") == 1) | ((F.col("node_id") == "root") & F.col("is_leaf")))
    inside = membership.join(first.select("node_id", F.coalesce("child_ix", F.lit(0)).alias("label")), "node_id").select("row_id", "label")
    return rows.select("row_id").join(inside, "row_id", "left").select("row_id", F.coalesce("label", F.lit(-1)).alias("label"))


def child_labels(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(node_id, row_id, label) for inner nodes: index of the row's child, -1 for none."""
    inner = nodes.where(~F.col("is_leaf")).select("node_id")
    inside = (
        membership.withColumnRenamed("node_id", "child_id")
        .join(nodes.where(F.col("parent_id").isNotNull()).select(F.col("node_id").alias("child_id"), F.col("parent_id").alias("node_id"), "child_ix"), "child_id")
        .select("node_id", "row_id", "child_ix")
    )
    rows = membership.join(inner, "node_id")
    return rows.join(inside, ["node_id", "row_id"], "left").select("node_id", "row_id", F.coalesce("child_ix", F.lit(-1)).alias("label"))


def scoring_k(n: Column) -> Column:
    """Neighbourhood size for scoring a node of ``n`` rows; null where it is too small."""
    k = F.least(F.lit(EVAL_K), F.floor((n - 1) / 2)).cast("int")
    return F.when((n >= MIN_ROWS_FOR_K) & (k >= 1), k)


def fixed_k(n: Column) -> Column:
    return F.when(n >= MIN_SCORE_ROWS, F.lit(SCORE_FLOOR_K))


def faithfulness_mean(scores: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of trustworthiness and continuity over scored nodes, and the share of leaf rows scored."""
    keys = list(by)
    both = (F.col("trustworthiness") + F.col("continuity")) / 2
    joined = nodes.join(scores.select(*keys, "node_id", "trustworthiness", "continuity"), [*keys, "node_id"], "left")
    leaf_rows = F.when(F.col("is_leaf"), F.col("n_points"))
    return joined.groupBy(*keys).agg(
        F.avg(both).alias("tnc_mean"),
        F.count(both).alias("n_scored_nodes"),
        F.coalesce(F.sum(F.when(both.isNotNull(), leaf_rows)) / F.sum(leaf_rows), F.lit(0.0)).alias("scored_coverage"),
    )
