"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.scratch import discard, materialize

#: Edges of a table whose per-node minima (two rows an edge at most) are broadcast; those of larger ones are written and joined by shuffle.
SMALL = 100_000


def _state(star: DataFrame) -> tuple[int, int]:
    """Edges, and nodes that are not settled: those with two lower neighbours, and those that are above one node and below another.

    Without the latter each node's one edge leads to the smallest node that it reaches.
    """
    ends = star.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(star.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return tuple(nodes.agg(F.coalesce(F.sum("above"), F.lit(0)), F.count_if(F.col("above") + F.col("below") > 1)).first())


def _joined(edges: DataFrame, low: DataFrame, small: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Edges with ``m`` of their ``u``, and the tables written for it. A written table lets Spark split a hub's many edges."""
    if small:
        return edges.join(F.broadcast(low), "u"), []
    low = materialize(low)
    return edges.join(low, "u"), [low]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: every node of an edge with the smallest node that it reaches.

    Each round works on (node, minimum of its neighbours) aggregates, so a hub's edges are
    combined before the shuffle; rounds grow with the logarithm of the graph's diameter, and end when the table is a set of stars.
    The rounds' tables are written to the shared scratch folder. Self-loops, repeated edges
    and an empty table are allowed; edges with a null end are ignored.
    """
    star = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count, open_nodes = _state(star)
    while open_nodes:
        small = count <= SMALL
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        higher, spent = _joined(both.where("v > u"), low, small)
        large = materialize(higher.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower, more = _joined(large, large.groupBy("u").agg(F.min("v").alias("m")), small)
        pairs = lower.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, star = star, materialize(pairs)
        count, open_nodes = _state(star)
        for done in (before, large, *spent, *more):
            discard(done)
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
