"""Distributed union-find.

Nothing here is gathered in one task or on the driver: groups are reduced with map-side aggregates and joined back, so that a
key that holds a third of all rows is split like any other skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeforge.session import stage_table

#: Rows of two longs up to which a table is broadcast (about 20 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Edges up to which a round's least ids, at most two for an edge, are broadcast, so that edges are shuffled less often.
FEW_EDGES = 50_000


def broadcast_if_small(staged: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of a few numeric columns for broadcast, if its counted rows are within the bound."""
    return F.broadcast(staged) if staged.count() <= limit else staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b), component being the smallest id that links reach.

    Alternating star contraction: each id hands its larger neighbours to its smallest one, then its smaller neighbours, until every id
    points at the smallest of its component. Rounds grow with the logarithm of the links; each is written out.
    Of up to FEW_EDGES edges the least ids are broadcast, and repeats stay until a round's end.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage_table(edges, "edges")
    before = _state(edges)
    while before[0]:
        few = before[0] <= FEW_EDGES
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(F.broadcast(least) if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b") if few else large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(F.broadcast(lowest) if few else lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stage_table(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.union(edges.select("b", "b").distinct()) if before[0] else ends


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """What :func:`components` gives for all links, if ``found`` (id, component) is what it gave for the others and ``links`` (a, b)
    are the rest. Only these are worked on, between the components that they join. ``found`` has been written."""
    roots = broadcast_if_small(found)
    ends = links
    for name in ("a", "b"):
        known = roots.select(F.col("id").alias(name), F.col("component").alias("root"))
        other = "b" if name == "a" else "a"
        ends = ends.join(known, name, "left").select(F.coalesce("root", name).alias(name), other)
    merged = stage_table(components(ends), "joined")
    less = broadcast_if_small(merged.select(F.col("id").alias("component"), F.col("component").alias("to")))
    kept = found.join(less, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return kept.unionByName(merged.join(roots, "id", "left_anti"))
