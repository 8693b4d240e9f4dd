"""Components and spanning trees of edge tables, keyed by node, by rounds of joins.

Every round contracts what it found, so edges and labels shrink from round to round; the
number of rounds is logarithmic in the size of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import hold

NODE = "node_id"


def to_roots(parent: DataFrame) -> DataFrame:
    """(node_id, c, p) with every pointer followed to its root (a root points to itself)."""
    parent = hold(parent)
    while True:
        up = parent.select(NODE, F.col("c").alias("p"), F.col("p").alias("p2"))
        step = parent.join(up, [NODE, "p"], "left").select(NODE, "c", "p", F.coalesce("p2", "p").alias("p2"))
        twice = step.select(NODE, F.col("c").alias("p2"), F.col("p2").alias("p4"))
        moved = hold(step.join(twice, [NODE, "p2"], "left").select(NODE, "c", F.coalesce("p4", "p2").alias("p"), (F.coalesce("p4", "p2") != F.col("p")).alias("moved")))
        parent = moved.select(NODE, "c", "p")
        if not moved.where("moved").limit(1).count():
            return parent


def relabel(df: DataFrame, parent: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(parent.select(NODE, F.col("c").alias(c), F.col("p").alias("__p")), [NODE, c], "left").withColumn(c, F.coalesce("__p", c)).drop("__p")
    return df


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, v, c): the smallest vertex of each vertex's component."""
    labels = vertices.select(NODE, "v", F.col("v").alias("c"))
    live = hold(edges.select(NODE, "a", "b").where(F.col("a") != F.col("b")).distinct())
    while live.limit(1).count():
        both = live.unionByName(live.select(NODE, F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(NODE, F.col("a").alias("c")).agg(F.min("b").alias("p")).select(NODE, "c", F.least("c", "p").alias("p"))
        parent = to_roots(hooks)
        labels = hold(relabel(labels, parent, "c"))
        live = hold(relabel(live, parent, "a", "b").where(F.col("a") != F.col("b")).distinct())
    return labels


def spanning_edges(edges: DataFrame) -> DataFrame:
    """(node_id, a, b, w) of a minimum spanning forest.

    Each component picks its cheapest way out, ties by vertex ids, so no round can close a
    cycle. Only the cheapest of parallel connections is carried on.
    """
    live = hold(edges.select(NODE, "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")).where(F.col("a") != F.col("b")))
    kept = None
    while live.limit(1).count():
        out = live.select(NODE, F.col("ca").alias("c"), F.struct("w", "a", "b", F.col("cb").alias("p")).alias("e")).unionByName(
            live.select(NODE, F.col("cb").alias("c"), F.struct("w", "a", "b", F.col("ca").alias("p")).alias("e"))
        )
        best = hold(out.groupBy(NODE, "c").agg(F.min("e").alias("e")).select(NODE, "c", "e.p", "e.w", "e.a", "e.b"))
        picked = best.select(NODE, "a", "b", "w").distinct()
        kept = picked if kept is None else kept.unionByName(picked)
        back = best.select(NODE, F.col("c").alias("p"), F.col("p").alias("pp"))
        first = F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p"))
        parent = to_roots(best.select(NODE, "c", "p").join(back, [NODE, "p"], "left").select(NODE, "c", first.alias("p")))
        moved = relabel(live, parent, "ca", "cb").where(F.col("ca") != F.col("cb"))
        low, high = F.least("ca", "cb"), F.greatest("ca", "cb")
        slim = moved.groupBy(NODE, low.alias("ca"), high.alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
        live = hold(slim.select(NODE, "e.a", "e.b", "e.w", "ca", "cb"))
    if kept is None:
        return edges.select(NODE, "a", "b", "w").limit(0)
    return hold(kept)
