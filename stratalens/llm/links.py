"""Classes of things that share buckets and are linked by a check, without a table of all pairs.

In a round every bucket names one leader; members of other classes are checked against it, linked
ones join its class, and the leader, which has now met them all, leaves the bucket. Buckets with
members of one class only are finished. Leaders come from the smallest class of their bucket, so
that a few outsiders beside a large class meet it in a few rounds. Rounds go on while each finishes
at least half of what was left; then the rest meets block by block, so that every two members of a
bucket that are not yet in one class are checked, and none is dropped however large its bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK = 256


def components(edges: DataFrame) -> DataFrame:
    """(v, c) of every end of ``edges`` (a, b): the smallest vertex it is connected with.

    A round hooks every vertex to its smallest neighbour, follows the pointers to their roots by
    doubling and keeps only the edges between different roots: logarithmic rounds.
    """
    live = edges.select("a", "b").where(F.col("a") != F.col("b"))
    labels = None
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")))
        if parent.isEmpty():
            return labels if labels is not None else parent.select("v", F.col("p").alias("c"))
        parent = _roots(parent)
        if labels is None:
            labels = parent.select("v", F.col("p").alias("c"))
        else:
            up = parent.select(F.col("v").alias("c"), F.col("p").alias("up"))
            labels = labels.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"))
        step = lambda c: parent.select(F.col("v").alias(c), F.col("p").alias(f"p_{c}"))
        live = live.join(step("a"), "a").join(step("b"), "b").select(F.col("p_a").alias("a"), F.col("p_b").alias("b"))
        live = stored(live.where(F.col("a") != F.col("b")).distinct())
        if live.isEmpty():
            return stored(labels)
        labels = stored(labels)


def _roots(parent: DataFrame) -> DataFrame:
    """Every pointer followed to a vertex that points to itself."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("up"))
        parent = stored(parent.join(up, "p").select("v", F.col("up").alias("p"), (F.col("up") != F.col("p")).alias("moved")))
        moved = not parent.where("moved").isEmpty()
        parent = parent.select("v", "p")
        if not moved:
            return parent


def classes(live: DataFrame, linked: Callable[[DataFrame], DataFrame], linked_blocks: Callable[[DataFrame], DataFrame], leaders_first: bool = True) -> DataFrame:
    """(v, c) of every vertex with a link: its class by ``live`` (k, v), bucket and vertex, from ``shared``.

    ``linked`` keeps the pairs (a, b) that hold; ``linked_blocks`` takes (g, v, c), groups of
    vertices with their classes so far, and returns pairs (a, b) that hold and connect what
    is connected within a group.
    """
    labels, left = None, live.count()
    if not left:
        return live.select("v", F.col("v").alias("c"))
    while leaders_first:
        known = _labelled(live, labels)
        leaders = known.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("leader"))
        leaders = leaders.groupBy("k").agg(F.min(F.struct("n", "leader", "c")).alias("m"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
        leaders = leaders.select("k", "m.leader", F.col("m.c").alias("of"))
        met = known.join(leaders, "k")
        pairs = met.where(F.col("c") != F.col("of")).select(F.col("v").alias("a"), F.col("leader").alias("b")).distinct()
        labels = _merged(labels, linked(pairs))
        # Buckets of several classes, without their leaders, by the new classes.
        live = _mixed(met.where(F.col("v") != F.col("leader")).select("k", "v"), labels)
        before, left = left, live.count()
        if not left:
            return labels
        leaders_first = 2 * left <= before
    rest = _labelled(live, labels)
    sizes = rest.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("v"), F.col("n")).cast("int")
    spread = rest.join(sizes, "k").select("k", "v", "c", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    group = F.concat_ws(" ", "k", F.least("i", "j"), F.greatest("i", "j"))
    return _merged(labels, linked_blocks(spread.select(group.alias("g"), "v", "c")))


def shared(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold two different vertices or more."""
    full = members.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("lo") != F.col("hi")).select("k")
    return stored(members.join(full, "k").distinct())


def _labelled(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return live.select("k", "v", F.col("v").alias("c"))
    return live.join(labels, "v", "left").select("k", "v", F.coalesce("c", "v").alias("c"))


def _mixed(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    known = _labelled(live, labels)
    mixed = known.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("k")
    return stored(live.join(mixed, "k").select("k", "v"))


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Classes so far, joined by newly found links."""
    return components(edges if labels is None else labels.select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(edges))
