"""Ranking and calibration measures as aggregates over windows. Ties are broken by an explicit key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.ordered import global_average_rank, global_prefix


def average_precision(df: DataFrame, score: str, relevant: str, tie: str, partition: list[str] = []) -> DataFrame:
    """(partition, ap): mean precision at the relevant rows, 0 without any."""
    order, hit = [F.col(score).desc(), F.col(tie)], F.col(relevant).cast("int")
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = df.withColumns({"__i": F.count(F.lit(1)).over(w), "__hits": F.sum(hit).over(w)})
    else:
        rows = global_prefix(df, order, {"__i": F.lit(1), "__hits": hit})
    precision = F.when(F.col(relevant), F.col("__hits") / F.col("__i")).otherwise(0.0)
    return rows.groupBy(*partition).agg(F.coalesce(F.try_divide(F.sum(precision), F.sum(hit)), F.lit(0.0)).alias("ap"))


def precision_at(df: DataFrame, group: str, place: str, relevant: str, total: str, k: int) -> DataFrame:
    """(group, ap): average precision of the first k places, over the smaller of `total` relevant ones and k."""
    w = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    top = df.filter(F.col(place) <= k).withColumn("__hits", F.sum(F.col(relevant).cast("int")).over(w))
    gain = F.when(F.col(relevant), F.col("__hits") / F.col(place)).otherwise(0.0)
    return top.groupBy(group).agg(F.try_divide(F.sum(gain), F.least(F.max(total), F.lit(k))).alias("ap"))


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(auc): by average ranks, null without both classes."""
    scored = df.filter(F.col(score).isNotNull()).select(score, F.col(positive).cast("int").alias("y"))
    ranked = global_average_rank(scored, score, "r")
    p, n = F.sum("y"), F.count(F.lit(1))
    return ranked.agg(F.try_divide(F.sum(F.col("r") * F.col("y")) - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def log_loss(df: DataFrame, probability: str, positive: str, floor: float = 1e-6) -> DataFrame:
    """(n, logloss, accuracy, base_logloss): the last one of the share of positives itself."""
    p, y = F.least(F.greatest(F.col(probability), F.lit(floor)), F.lit(1 - floor)), F.col(positive).cast("double")
    b = F.least(F.greatest(F.avg(y), F.lit(floor)), F.lit(1 - floor))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("logloss"),
        F.avg(((p >= 0.5) == F.col(positive)).cast("double")).alias("accuracy"), (-(F.avg(y) * F.ln(b) + (1 - F.avg(y)) * F.ln(1 - b))).alias("base_logloss"),
    )


def calibration(df: DataFrame, probability: str, positive: str, bins: int) -> DataFrame:
    """(bin, n, mean_p, share): equal bins of [0, 1], the last one closed."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_p"), F.avg(F.col(positive).cast("double")).alias("share"))


def paired_bootstrap(df: DataFrame, unit: str, a: str, b: str, replicates: int, seed: int = 0) -> DataFrame:
    """(mean_difference, p_better, low, high) of sum(b - a) over resampled units.

    Each unit draws a Poisson(1) weight per replicate from a generator seeded by its own hash, so tasks need nothing from
    each other; replicate sums are added up without a collect. Nulls in a or b add 0; an empty input gives p_better null.
    """
    spec = df.groupBy(unit).agg(F.sum(F.coalesce(F.col(b) - F.col(a), F.lit(0.0)).cast("double")).alias("d")).select(F.xxhash64(unit).alias("h"), "d")

    def draw(frames):
        total, shifted = np.zeros(replicates), np.zeros(replicates)
        for frame in frames:
            for h, d in zip(frame["h"].tolist(), frame["d"].tolist()):
                weights = np.random.default_rng([seed, h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF]).poisson(1.0, replicates)
                total += weights * d
                shifted += weights
        yield pd.DataFrame({"r": range(replicates), "d": total, "w": shifted})

    sums = spec.mapInPandas(draw, "r int, d double, w double").groupBy("r").agg(F.try_divide(F.sum("d"), F.sum("w")).alias("m"))
    return sums.agg(
        F.avg("m").alias("mean_difference"), F.avg((F.col("m") > 0).cast("double")).alias("p_better"),
        F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"),
    )
