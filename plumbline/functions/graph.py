"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in an edge; component is the smallest node reachable.

    Every round contracts the graph with two aggregations and two joins on the edge table alone, so the
    work is distributed and no component is ever gathered in a task. Rounds grow with the logarithm of the
    longest path. Null ends and self loops are ignored; an empty edge table gives an empty result.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = durable(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        e = durable(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        # 128 bits of hashes tell whether the edges are those of the last round
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merged_components(comp: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the graph that ``comp`` is the result for, with more edges: only the graph of components is run again.

    Both inputs are read several times: pass checkpoints. Ends that ``comp`` doesn't know are nodes of their own.
    """
    label = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(label("a"), "a", "left").join(label("b"), "b", "left")
    across = durable(connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    moved = across.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = comp.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return old.unionByName(across.join(comp.select("node"), "node", "left_anti"))
