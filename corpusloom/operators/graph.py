"""Graphs as edge tables: connected components, forest roots, members of trees, redirect sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.runtime import broadcast_if_small, free, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Alternates large-star and small-star steps until the edges are stars; each
    step is one aggregation and one join, so a node of any degree is split like
    any skewed key. ``edges`` is computed once; the tables of a round go when the next one stands. Null
    ends are ignored, loops and repeated edges do no harm, an empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    whole = stars = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = None
    while True:
        links = stars.where("u <> v")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written before it is joined: then both sides have exchanges of their own and a node of many edges is split
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-stars")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hung = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, stars = stars, materialize(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        free(least, large, low, *(() if before is whole else (before,)))
        now = tuple(stars.agg(F.count("u"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == digest or not now[0]:
            break
        digest = now
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = whole.where("u = v").select(F.col("u").alias("node")).join(members, "node", "left_anti").select("node", F.col("node").alias("component"))
    return members.unionByName(roots).unionByName(alone).distinct()


def forest_roots(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(node): those of ``nodes`` that redirect to no other; edges say that src redirects to dst."""
    return nodes.select(node).distinct().join(edges.select(F.col(src).alias(node)).distinct(), node, "left_anti")


def forest_members(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(root, node): each root and all that reach it by redirects, itself included.

    Every node points at where it redirects to, and each round lets it point where its
    targets point, so paths of any length need as many rounds as their length has bits. Nodes on a cycle
    have no root, and rounds end when even the longest path would have been walked, so cycles end too; what
    still points at no root then is left out.
    """
    links = edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).where("node IS NOT NULL AND to IS NOT NULL").distinct()
    roots = materialize(forest_roots(edges, nodes, src, dst, node).where(F.col(node).isNotNull()).select(F.col(node).alias("root")), "roots")
    flagged = links.join(broadcast_if_small(roots), F.col("to") == F.col("root"), "left").select("node", "to", F.col("root").isNotNull().alias("done"))
    pointers = materialize(flagged, "pointers")
    for _ in range(pointers.count().bit_length() + 1):
        if pointers.where("NOT done").isEmpty():
            break
        further = pointers.select(F.col("node").alias("to"), F.col("to").alias("__next"), F.col("done").alias("__done"))
        step = pointers.where("NOT done").select("node", "to").join(further, "to").select("node", F.col("__next").alias("to"), F.col("__done").alias("done"))
        before, pointers = pointers, materialize(pointers.where("done").unionByName(step).distinct(), "pointers")
        free(before)
    found = pointers.where("done").select(F.col("to").alias("root"), "node").distinct()
    return found.unionByName(roots.select("root", F.col("root").alias("node")))


def root_of(members: DataFrame) -> DataFrame:
    """(node, root): the smallest root where a node has several."""
    return members.groupBy("node").agg(F.min("root").alias("root"))


def redirect_sets(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(target, sources, n): the set of names that redirect to each target, sorted, over all of its rows.

    The names of one article are one array; (src, dst) pairs themselves, distinct, are the form for graph operators.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(dst).alias("target"), F.col(src).alias("source"))
    return pairs.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources")).withColumn("n", F.size("sources").cast("long"))
