"""Connected components over DataFrames, without collecting nodes, links or groups anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One star operation: links the neighbours of each node to the least of them.

    The least neighbours are stored, so that both sides of the join are plain scans and adaptive
    execution can split the rows of a node with very many links.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = scratch(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return scratch(out.where("u <> v").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one link only, to a node that has none further down."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(links: DataFrame, keep: Scratch) -> DataFrame:
    """(node, component), stored in ``keep``, for every node of ``links`` (columns u and v, u <> v); a component is its least node.

    Alternates large-star and small-star until every node points at its component. Each step shuffles
    the links by one end; a node with many links is aggregated partially and its join can be split.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(edges):
        edges = _star(_star(edges, True, scratch), False, scratch)
        scratch.drop(edges)
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = keep(found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    scratch.drop()
    return out


def joined(found: DataFrame, links: DataFrame, keep: Scratch) -> DataFrame:
    """The components ``found`` with more links, by the graph of the components that they join."""
    label = F.coalesce("component", "node")
    one = links.select(F.col("u").alias("node"), "v").join(found, "node", "left").select(label.alias("u"), "v")
    two = one.select("u", F.col("v").alias("node")).join(found, "node", "left").select("u", label.alias("v")).where("u <> v").distinct()
    merged = components(two, keep)
    moved = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return keep(moved.unionByName(merged.join(found.select("node"), "node", "left_anti")))
