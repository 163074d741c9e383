"""Pairs of group members, and lookups between tables, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(rows: DataFrame, group: str, member: str, directed: bool = False) -> DataFrame:
    """(x, y, n): groups that two members share, each unordered pair once as x < y, or both ways if directed."""
    r = rows.select(group, member).filter(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    a, b = r.alias("a"), r.alias("b")
    differ = F.col(f"a.{member}") != F.col(f"b.{member}") if directed else F.col(f"a.{member}") < F.col(f"b.{member}")
    return (
        a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & differ)
        .groupBy(F.col(f"a.{member}").alias("x"), F.col(f"b.{member}").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def both_present(pairs: DataFrame, x: str, y: str, rows: DataFrame, group: str, member: str) -> DataFrame:
    """(pair columns, group): the groups in which both members of a listed pair are present."""
    r = rows.select(group, member).distinct()
    first = pairs.join(r.withColumnRenamed(member, x), x)
    return first.join(r.withColumnRenamed(member, y), [group, y])


def both_orientations(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Each pair as (x, y) and as (y, x), with `swapped`."""
    kept = pairs.withColumn("swapped", F.lit(False))
    turned = pairs.withColumnsRenamed({x: "__x"}).withColumnsRenamed({y: x}).withColumnsRenamed({"__x": y}).withColumn("swapped", F.lit(True))
    return kept.unionByName(turned)


def back_off(rows: DataFrame, fine: DataFrame, fine_keys: list[str], coarse: DataFrame, coarse_keys: list[str], rate: str, n: str, least: int) -> DataFrame:
    """The rate of the fine cell if it has at least `least` observations, else that of the coarse one; null if there is neither."""
    f = fine.select(*fine_keys, F.col(rate).alias("__fine"), F.col(n).alias("__n"))
    c = coarse.select(*coarse_keys, F.col(rate).alias("__coarse"))
    joined = rows.join(f, fine_keys, "left").join(c, coarse_keys, "left")
    return joined.withColumn(rate, F.when(F.col("__n") >= least, F.col("__fine")).otherwise(F.col("__coarse"))).drop("__fine", "__n", "__coarse")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, width: float) -> DataFrame:
    """Rows of both whose keys agree and whose `at` and `other` lie at most width apart, found through buckets of that width.

    Every left row meets three buckets, so the join is an equi-join that shuffles on keys and bucket.
    """
    size = max(width, 1)
    l = left.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(at) / size) + k)))
    r = right.withColumn("__b", F.floor(F.col(other) / size))
    return l.join(r, [*keys, "__b"]).filter(F.abs(F.col(at) - F.col(other)) <= width).drop("__b")


def uncovered(left: DataFrame, right: DataFrame, keys: list[str]) -> Column | DataFrame:
    """Keys of left that right does not have."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def window_rows(rows: DataFrame, clock: str, windows: dict[str, tuple[int, int | None]]) -> DataFrame:
    """Each row once for every named window (low <= clock < high, None being open) that holds it; windows may overlap."""
    named = F.array(*(F.struct(F.lit(w).alias("name"), F.lit(low).alias("low"), F.lit(high).cast("bigint").alias("high")) for w, (low, high) in windows.items()))
    inside = F.filter(named, lambda w: (F.col(clock) >= w["low"]) & (w["high"].isNull() | (F.col(clock) < w["high"])))
    return rows.withColumn("window", F.explode(F.transform(inside, lambda w: w["name"])))
