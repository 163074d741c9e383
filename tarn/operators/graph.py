"""Connected components of links between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.skew import SALTED_ROWS, salted_join
from tarn.plans.lineage import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _attach(edges: int):
    """Joins edges with one row per node; the node of a large star is spread over tasks, where there are edges enough for one."""
    if edges * 2 <= SALTED_ROWS:
        return lambda rows, low: rows.join(low.drop("c"), "u")
    return lambda rows, low: salted_join(rows, low, ["u"], "c", ["v"])


def connected_components(links: DataFrame, node: str, via: str) -> DataFrame:
    """(node, component): nodes tied by a common `via`, over any number of steps; component is the smallest node.

    links has one row per node and via; nulls in either do not count, repeated rows count once, other columns are ignored;
    an empty input gives no rows. Every node of links gets a row, also one that shares its via with nobody.

    A via ties its nodes to its smallest one, so a via with a third of all rows costs as many edges as it has nodes; such a via,
    and a node with as many edges, is spread over tasks. Then
    large-star and small-star steps alternate until the edges no longer change, which takes about log(nodes) rounds; each
    round is cut to the shared checkpoint folder.
    """
    pairs = cut(
        links.select(F.col(node).alias("u"), F.col(via).alias("p")).filter(F.col("u").isNotNull() & F.col("p").isNotNull()).distinct()
    )
    least = pairs.groupBy("p").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("c"))
    edges = cut(salted_join(pairs, least, ["p"], "c", ["u"]).filter("u > v").select("u", "v").distinct())
    before = None
    while (now := _mark(edges)) != before:
        before = now
        attach = _attach(now[0])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = attach(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = attach(large, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u > v").distinct())
    nodes = pairs.select("u").distinct()
    return nodes.join(edges, "u", "left").select(F.col("u").alias(node), F.coalesce("v", "u").alias("component"))
