"""Rates against population and leave-one-out baselines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tarn.operators.skew import with_group

#: Fixed values of the method.
Z_FLOOR = 1e-9
RATE_FLOOR = 1e-6
PSEUDO = 1.0
SHRINK = 20.0


def over(*partition: str):
    return Window.partitionBy(*partition)


def rate(hit: Column, n: Column) -> Column:
    """hit / n, null if n is 0 or null."""
    return F.try_divide(hit.cast("double"), n.cast("double"))


def binomial_z(hit: Column, n: Column, p: Column) -> Column:
    return (hit - n * p) / F.sqrt(n * p * (1 - p) + F.lit(Z_FLOOR))


def with_global_rate(df: DataFrame, hit: str, n: str, name: str) -> DataFrame:
    """Adds sum(hit) / sum(n) over all rows, a one-row side."""
    base = df.agg(rate(F.sum(hit), F.sum(n)).alias(name))
    return df.crossJoin(F.broadcast(base))


def leave_one_out(hit: Column, n: Column, *partition: str) -> Column:
    """Rate of the other rows of the partition, null if they have no opportunity."""
    w = over(*partition)
    return rate(F.sum(hit).over(w) - hit, F.sum(n).over(w) - n)


def log_lift(hit: Column, expected: Column) -> Column:
    return F.ln((hit + F.lit(PSEUDO)) / (expected + F.lit(PSEUDO)))


def own_baseline(directed: DataFrame, hit: str, n: str) -> DataFrame:
    """directed has (x, y, hit, n). Adds the excess and log-lift over x's rate with all others, y's rank for x, and x's top flag."""
    sums = with_group(directed, ["x"], ["y"], __h=F.sum(hit), __m=F.sum(n))
    base = F.coalesce(rate(F.col("__h") - F.col(hit), F.col("__m") - F.col(n)), F.lit(0.0))
    rows = sums.withColumn("expected", F.col(n) * base).drop("__h", "__m")
    rows = rows.withColumn("excess", F.col(hit) - F.col("expected")).withColumn("llift", log_lift(F.col(hit), F.col("expected")))
    place = F.row_number().over(over("x").orderBy(F.round("llift", 9).desc(), F.col("y")))
    return rows.withColumn("rank", place).withColumn("top", F.col("rank") == 1)


def unordered(directed: DataFrame) -> DataFrame:
    """own_baseline() rows folded to pairs a < b."""
    return directed.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.sum("excess").alias("exc_sum"), F.min("excess").alias("exc_min"), F.sum("llift").alias("llift_sum"), F.min("llift").alias("llift_min"),
        F.max("llift").alias("llift_max"), F.bool_and("top").alias("mutual_top"), F.bool_or("top").alias("top_any"), F.max("rank").alias("rank_worst"),
    )


def leave_one_out_z(directed: DataFrame, hit: str, n: str) -> DataFrame:
    """directed has (x, y, hit, n). Adds z of the hits under x's rate with all others, that rate being kept off 0 and 1, so every row has one."""
    h, m = F.col(hit), F.col(n)
    sums = with_group(directed, ["x"], ["y"], __h=F.sum(h), __m=F.sum(m))
    other = (F.col("__h") - h) / F.greatest(F.col("__m") - m, F.lit(1))
    rows = sums.withColumn("__p", F.least(F.greatest(other, F.lit(RATE_FLOOR)), F.lit(1 - RATE_FLOOR)))
    return rows.withColumn("z", (h - m * F.col("__p")) / F.sqrt(m * F.col("__p") * (1 - F.col("__p")))).drop("__p", "__h", "__m")


def softmax_gap(df: DataFrame, partition: str, score: str, tie: str) -> DataFrame:
    """Adds the softmax share inside the partition and the gap to the best other row."""
    w = over(partition)
    top = F.max(score).over(w)
    e = F.exp(F.col(score) - top)
    ordered = F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie)))
    df = df.withColumn("share", e / F.sum(e).over(w)).withColumn("__r", ordered).withColumn("__top", top)
    second = F.max(F.when(F.col("__r") == 2, F.col(score))).over(w)
    return df.withColumn("gap", F.col(score) - F.when(F.col("__r") == 1, second).otherwise(F.col("__top"))).drop("__r", "__top")


def row_column_expectation(df: DataFrame, scope: str, hit: str, n: str) -> DataFrame:
    """df has (scope, x, y). Expected hits if x's and y's tendencies were independent in the scope, each shrunk to the scope's
    rate with SHRINK pseudo-opportunities and without the pair itself, no rate being above 1; and the signed Poisson deviance of the hits."""
    h, m = F.col(hit), F.col(n)
    whole = rate(F.sum(h).over(over(scope)), F.sum(m).over(over(scope)))
    df = df.withColumn("__p", whole)
    for side in ("x", "y"):
        w = over(scope, side)
        df = df.withColumn(f"__{side}", (F.sum(h).over(w) - h + F.lit(SHRINK) * F.col("__p")) / (F.sum(m).over(w) - m + F.lit(SHRINK)))
    df = df.withColumn("expected", F.coalesce(m * F.least(F.try_divide(F.col("__x") * F.col("__y"), F.col("__p")), F.lit(1.0)), F.lit(0.0)))
    return df.withColumn("g", signed_poisson(h, F.col("expected"))).drop("__p", "__x", "__y")


def signed_poisson(hit: Column, expected: Column) -> Column:
    """sign(c - E) * 2 (c ln(c / E) - (c - E)); 0 where nothing is expected, 0 ln 0 = 0."""
    e = F.greatest(expected, F.lit(1e-12))
    core = F.when(hit > 0, hit * F.ln(hit / e)).otherwise(F.lit(0.0)) - (hit - expected)
    return F.when(expected <= 0, F.lit(0.0)).otherwise(F.signum(hit - expected) * 2 * core)


def group_z(value: Column, *partition: str) -> Column:
    """(value - mean) / sample standard deviation inside the partition, null without spread."""
    w = over(*partition)
    return F.try_divide(value - F.avg(value).over(w), F.stddev_samp(value).over(w))


def other_mean(value: Column, *partition: str) -> Column:
    """Mean of the partition's other rows, null if there are none."""
    w = over(*partition)
    return F.try_divide(F.sum(value).over(w) - value, F.count(value).over(w) - 1)


def wilson(hit: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share."""
    p, m = rate(hit, n), n.cast("double")
    centre, spread = p + F.lit(z * z) / (2 * m), F.lit(z) * F.sqrt(p * (1 - p) / m + F.lit(z * z) / (4 * m * m))
    return (centre - spread) / (1 + F.lit(z * z) / m), (centre + spread) / (1 + F.lit(z * z) / m)


def histogram_llr(df: DataFrame, value: str, positive: str, edges: list[float], pi: float) -> DataFrame:
    """Adds log1p(pi * (LR - 1)), LR being the ratio of the bins' shares among positives and negatives (add-one smoothed)."""
    bin_ = sum(((F.col(value) > e).cast("int") for e in edges), F.lit(0))
    df = df.withColumn("bin", bin_)
    bins = len(edges) + 1
    counts = df.groupBy("bin").agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum((~F.col(positive)).cast("bigint")).alias("q"))
    totals = counts.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    ratio = ((F.col("p") + 1) / (F.col("tp") + bins)) / ((F.col("q") + 1) / (F.col("tq") + bins))
    table = counts.crossJoin(F.broadcast(totals)).select("bin", F.log1p(F.lit(pi) * (ratio - 1)).alias("llr"))
    return df.join(F.broadcast(table), "bin")  # as many rows as bins


def _quantile_near(x: float, rate: float) -> int:
    """The least k with P(Poisson(rate) <= k) > x, for a large rate: terms up to twelve deviations either way of the mode."""
    mode, spread = int(rate), int(12 * math.sqrt(rate)) + 40
    low = max(0, mode - spread)
    k = np.arange(low + 1, mode + spread + 1)
    steps = np.concatenate([[0.0], np.cumsum(np.log(rate / k))])
    below = np.cumsum(np.exp(steps - steps[mode - low] + mode * math.log(rate) - rate - math.lgamma(mode + 1)))
    return low + min(int(np.searchsorted(below, x, side="right")), len(k))


@F.pandas_udf(LongType())
def poisson_quantile(u: pd.Series, rate: pd.Series) -> pd.Series:
    """The least k with P(Poisson(rate) <= k) > u: a draw, if u is uniform. Null rates give 0."""
    every, x = np.clip(rate.fillna(0).to_numpy(float), 0, None), u.fillna(0).to_numpy(float)
    large = every > 600
    r = np.where(large, 0.0, every)
    p = np.exp(-r)
    total, out = p.copy(), np.zeros(len(r), np.int64)
    for k in range(1, int(r.max(initial=0) + 10 * np.sqrt(r.max(initial=0)) + 40)):
        below = (total <= x) & ~large
        if not below.any():
            break
        out += below
        p = p * r / k
        total += p
    for i in np.flatnonzero(large):
        out[i] = _quantile_near(x[i], every[i])
    return pd.Series(out)
