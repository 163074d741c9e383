"""Row and column shaping: repeatable samples, list and name handling, pivots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def uniform(*keys: str, seed: str = "") -> Column:
    """A number in [0, 1) that depends on nothing but the keys and the seed: the first 13 hex digits of their MD5."""
    digest = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def sample_rate(df: DataFrame, rate: Column, *keys: str, seed: str = "") -> DataFrame:
    """Keeps a row with the given chance, which may differ by row; repeatable."""
    return df.filter(uniform(*keys, seed=seed) < rate)


def sample_n(df: DataFrame, n: int, *keys: str, seed: str = "") -> DataFrame:
    """n rows drawn evenly; repeatable if keys are unique. Runs as a top-n, without a full sort."""
    return df.withColumn("__u", uniform(*keys, seed=seed)).orderBy("__u", *keys).limit(n).drop("__u")


def sample_n_per_group(df: DataFrame, group: str, n: int, *keys: str, seed: str = "") -> DataFrame:
    """Up to n rows of every group, drawn evenly; repeatable."""
    w = Window.partitionBy(group).orderBy("__u", *keys)
    return df.withColumn("__u", uniform(*keys, seed=seed)).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__u", "__r")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*(c for c in df.columns if not re.search(pattern, c)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def drop_constant(df: DataFrame) -> DataFrame:
    """Without the numeric columns that hold at most one different value besides nulls: one aggregate over the table."""
    names = numeric_columns(df)
    if not names:
        return df
    spread = df.agg(*((F.coalesce(F.max(c) > F.min(c), F.lit(False))).alias(c) for c in names)).first()
    return df.drop(*(c for c in names if not spread[c]))


def pivot(df: DataFrame, keys: list[str], column: str, values: list, measures: dict[str, Column]) -> DataFrame:
    """Long to wide by conditional aggregates, with columns <value>_<measure>; measures are of one row each."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(column) == v, m)).alias(f"{v}_{name}") for v in values for name, m in measures.items()))


def bins(value: Column, edges: list[float], left_closed: bool = True) -> Column:
    """Index of the bin between sorted edges; null for null."""
    inside = [(value >= e) if left_closed else (value > e) for e in edges]
    return sum((c.cast("int") for c in inside), F.lit(0))


def interpolate(value: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), constant outside."""
    out = F.lit(float(ys[-1]))
    for x0, x1, y0, y1 in reversed(list(zip(xs, xs[1:], ys, ys[1:]))):
        out = F.when(value < x1, F.lit(float(y0)) + (value - x0) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(value < xs[0], F.lit(float(ys[0]))).otherwise(out)


def renormalised(probabilities: list[Column], mask: Column, bits: list[int]) -> list[Column]:
    """Probabilities of the allowed classes, scaled to sum to 1; even among them if they have no mass; null if none is allowed."""
    allowed = [mask.bitwiseAND(F.lit(b)) != 0 for b in bits]
    kept = [F.when(a, p).otherwise(F.lit(0.0)) for a, p in zip(allowed, probabilities)]
    mass, count = sum(kept, F.lit(0.0)), sum((a.cast("int") for a in allowed), F.lit(0))
    return [F.when(mass > 0, k / mass).otherwise(F.try_divide(a.cast("double"), count.cast("double"))) for a, k in zip(allowed, kept)]
