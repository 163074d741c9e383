"""Ranks and top-k with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.ordered import row_index


def average_rank(score: Column, *partition: str, descending: bool = False) -> Column:
    """Rank from 1 in which equal scores share the mean of their places."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(score.desc() if descending else score.asc())) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, score)) - 1) / 2


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of every partition; Spark keeps k rows a task before it shuffles."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(place) <= k)


def union_top_k(df: DataFrame, partition: list[str], scores: list[str], tie: str, k: int) -> DataFrame:
    """Rows among the k best by any of the scores, with their best place."""
    w = Window.partitionBy(*partition)
    places = [F.row_number().over(w.orderBy(F.col(s).desc_nulls_last(), F.col(tie))) for s in scores]
    return df.withColumn("best_place", F.least(*places)).filter(F.col("best_place") <= k)


def unit_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Place from the end over n + 1, so the first row is nearest to 1."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return row_index(df, order, "__i").crossJoin(F.broadcast(n)).withColumn(name, 1 - (F.col("__i") + 1) / (F.col("__n") + 1)).drop("__i", "__n")  # one row


def argmax_label(columns: list[str]) -> Column:
    """Name of the column with the greatest value, the first named among equals; null if all are null."""
    top = F.greatest(*columns)
    out = F.lit(None).cast("string")
    for c in reversed(columns):
        out = F.when(F.col(c) == top, c).otherwise(out)
    return out


def map_quantiles(df: DataFrame, score: str, onto: str, tie: str, name: str) -> DataFrame:
    """Each row's score replaced by the `onto` value that has the same place."""
    right = row_index(df.select(F.col(onto).alias(name), tie), [name, tie], "__i").drop(tie)
    return row_index(df, [score, tie], "__i").join(right, "__i").drop("__i")
