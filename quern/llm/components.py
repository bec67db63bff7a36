"""Connected components of links, in rounds of parent choice, pointer jumps and contraction.

The links are a table; no round brings them, or components, to the driver. In each round
every node takes the first of itself and its neighbours as its parent, and links are drawn
between parents; links inside a parent vanish. The first round orders nodes by id, which
settles stars around their smallest node; later ones, with a pointer jump to the parent's
parent, by a hash of the id, so that no numbering of the nodes, such as a
chain of ascending ids, makes long walks: each of them leaves less than half of a chain, in
expectation. The smallest node names the component at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import stage


def _first(rows: DataFrame, by_hash: bool) -> DataFrame:
    """(node, parent): the first of each node and its neighbours in (node, other)."""
    if not by_hash:
        return rows.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent"))

    def placed(node: Column) -> Column:
        return F.struct(F.xxhash64(node).alias("h"), node.alias("id"))

    least = rows.groupBy("node").agg(F.min(placed(F.col("other"))).alias("least"))
    return least.select("node", F.least(placed(F.col("node")), "least")["id"].alias("parent"))


def connected_components(spark: SparkSession, links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Repeated and reversed links, and links of a node to itself, do no harm; rows with a null
    are left out. No links: an empty table. ``rounds`` is told the number of links left
    before each round.
    """
    ordered = links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    loops = ordered.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    current = stage(spark, ordered.where("a < b").distinct(), "links")
    mapping, turns = None, 0
    while left := current.count():
        if rounds is not None:
            rounds.append(left)
        by_hash = turns > 0
        ends = current.select(F.col("a").alias("node"), F.col("b").alias("other")).union(current.select("b", "a"))
        parents = stage(spark, _first(ends, by_hash), "parents")
        if by_hash:
            far = parents.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
            parents = stage(spark, parents.join(far, "parent").select("node", F.col("far").alias("parent")), "parents")
        at = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        bt = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        drawn = current.join(at, "a").join(bt, "b").where("pa <> pb")
        current = stage(spark, drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if mapping is None:
            mapping = parents.withColumnRenamed("parent", "component")
        else:
            up = parents.select(F.col("node").alias("component"), F.col("parent").alias("up"))
            moved = mapping.join(up, "component", "left")
            mapping = stage(spark, moved.select("node", F.coalesce("up", "component").alias("component")), "components")
        turns += 1
    if mapping is None:
        return loops
    if turns > 1:
        # after the first round, which orders by id, the root of a component need not be its smallest node
        least = mapping.groupBy("component").agg(F.min("node").alias("least"))
        mapping = mapping.join(least, "component").select("node", F.col("least").alias("component"))
    return mapping.unionByName(loops.join(mapping, "node", "left_anti"))
