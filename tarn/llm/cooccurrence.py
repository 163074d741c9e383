"""Problem 3: how often two items share a basket, against chance (basket collapsing)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.lineage import cut


def _blocked(large: DataFrame, block: int) -> DataFrame:
    """(scope, w, item_a, item_b) of large baskets: an item meets the others block by block, so a task holds two blocks."""
    named = large.withColumn("b", F.md5(F.array_join(F.transform("items", lambda x: x.cast("string")), ",")))
    rows = named.select("scope", "b", "w", F.ceil(F.size("items") / block).cast("int").alias("m"), F.posexplode("items").alias("i", "item"))
    k = F.floor(F.col("i") / block).cast("int")
    left = rows.select("scope", "b", "w", k.alias("p"), F.explode(F.sequence(k, F.col("m") - 1)).alias("q"), F.col("i").alias("i"), F.col("item").alias("item_a"))
    right = rows.select("scope", "b", F.explode(F.sequence(F.lit(0), k)).alias("p"), k.alias("q"), F.col("i").alias("j"), F.col("item").alias("item_b"))
    return left.join(right, ["scope", "b", "p", "q"]).filter("i < j").select("scope", "w", "item_a", "item_b")


def item_pairs(baskets: DataFrame, scope: str, items: str, min_pairs: int = 1, block: int = 1_000) -> DataFrame:
    """(scope, item_a, item_b, n_ab, n_a, n_b, n, lift, conviction_ab, conviction_ba) with item_a < item_b.

    baskets has one row per basket, items being its array. Within a scope n is the number of baskets with any item, n_a
    and n_b those with each item, n_ab those with both. lift is n_ab * n / (n_a * n_b); conviction_ab is
    (1 - n_b / n) / (1 - n_ab / n_a), null where a never occurs without b. Items count once in a basket; null items, null
    scopes and empty or null arrays do not count; other columns are ignored; an empty input gives no rows.

    Identical item arrays are first collapsed to one weighted basket, and pairs are enumerated once per different one. Up to
    `block` items, a basket's pairs are made where it lies; a larger one is cut into blocks, whose pairs are spread over tasks.
    """
    distinct = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    weighted = cut(
        baskets.select(F.col(scope).alias("scope"), distinct.alias("items"))
        .filter(F.col("scope").isNotNull() & (F.size("items") > 0))
        .groupBy("scope", "items")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    small = weighted.filter(F.size("items") <= block).select("scope", "items", "w", F.posexplode("items").alias("i", "item_a"))
    small = small.select("scope", "w", "item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"))
    pairs = (
        small.unionByName(_blocked(weighted.filter(F.size("items") > block), block))
        .groupBy("scope", "item_a", "item_b")
        .agg(F.sum("w").alias("n_ab"))
        .filter(F.col("n_ab") >= min_pairs)
    )
    single = weighted.select("scope", "w", F.explode("items").alias("item")).groupBy("scope", "item").agg(F.sum("w").alias("m"))
    total = weighted.groupBy("scope").agg(F.sum("w").alias("n"))
    of = lambda item, m: single.select("scope", F.col("item").alias(item), F.col("m").alias(m))
    a, b, ab, n = (F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab", "n"))
    conviction = lambda x, y: F.try_divide(1 - y / n, 1 - ab / x)
    return (
        pairs.join(total, "scope")
        .join(of("item_a", "n_a"), ["scope", "item_a"])
        .join(of("item_b", "n_b"), ["scope", "item_b"])
        .select(
            F.col("scope").alias(scope), "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
            (ab * n / (a * b)).alias("lift"), conviction(a, b).alias("conviction_ab"), conviction(b, a).alias("conviction_ba"),
        )
    )
