"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.scratch import drop, stored

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` of longs to ``(id, component)``, the smallest id reachable.

    Every node of an edge is returned once, self-loops and repeated edges are
    allowed, and an edge with a null end is ignored.  Nodes with a single
    neighbour are set aside first and take that neighbour's component at the
    end, so the spokes of a hub are not dealt to one task in every round; the
    join that brings them back reads two written tables, which Spark can
    split where one key is hot.  Each round sends every node's larger
    neighbours, then its smaller ones, to the smallest neighbour; edges stay
    at most one for each node and neighbour, stars are reached in a number of
    rounds that is logarithmic in the number of nodes, and no edge leaves the
    executors.  An empty table gives an empty table.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).na.drop()
    loops = edges.where("u = v").select(F.col("u").alias("id"))
    first = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    ends = first.unionAll(first.select(F.col("v").alias("u"), F.col("u").alias("v")))
    one = ends.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("to")).where("n = 1").select("u", "to")
    # Of two that have only each other, the larger is set aside.
    pair = one.select(F.col("u").alias("to"), F.col("to").alias("u"), F.lit(True).alias("mutual"))
    leaves = stored(one.join(pair, ["u", "to"], "left").where("mutual is null or u > to").select("u", "to"), "leaves")
    gone = leaves.select(F.greatest("u", "to").alias("u"), F.least("u", "to").alias("v"))
    core = stored(first.join(gone, ["u", "v"], "left_anti"), "edges")
    found = stored(_stars(core).unionByName(leaves.select(F.col("to").alias("id"), F.col("to").alias("component"))).groupBy("id").agg(F.min("component").alias("component")), "found")
    # A leaf can be smaller than all that its neighbour reaches.
    hung = leaves.join(found.withColumnRenamed("id", "to"), "to").select(F.col("u").alias("id"), "component")
    least = stored(hung.groupBy("component").agg(F.min("id").alias("leaf")).where("leaf < component"), "least")
    every = found.unionByName(hung).join(least, "component", "left").select("id", F.least("component", "leaf").alias("component"))
    return every.unionByName(loops.join(every, "id", "left_anti").distinct().select("id", F.col("id").alias("component")))


def _stars(first: DataFrame) -> DataFrame:
    """``(id, component)`` of the nodes of distinct edges whose ``u`` is larger than ``v``."""
    spark = first.sparkSession
    cur, mark = first, None
    for _ in range(MAX_ROUNDS):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "edges")
        if cur is not first:
            drop(spark, cur)
        cur = after
        seen = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen.n:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    nodes = first.select(F.col("u").alias("id")).union(first.select(F.col("v").alias("id"))).distinct()
    return nodes.join(cur.select(F.col("u").alias("id"), F.col("v").alias("to")), "id", "left").select("id", F.coalesce("to", "id").alias("component"))
