"""Joins and shares that hold where one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key of more rows is spread over several tasks, one for so many rows; no more keys than HOT_KEYS, the most frequent, are.
SALTED_ROWS = 1_000_000
HOT_KEYS = 10_000


def salted_join(rows: DataFrame, totals: DataFrame, keys: list[str], count: str, by: list[str], how: str = "inner", salted_rows: int | None = None) -> DataFrame:
    """rows joined with totals, which has one row per key and in `count` about how many rows the key has.

    Rows of a frequent key are spread by a hash of their `by` columns, and the key's one row is copied as often; only the list
    of frequent keys, at most HOT_KEYS of them, is broadcast. The others hold less than a HOT_KEYS-th of all rows each. The
    result is that of the plain join on the keys, without `count`.
    """
    each = salted_rows or SALTED_ROWS
    hot = totals.filter(F.col(count) > each).orderBy(F.col(count).desc(), *keys).limit(HOT_KEYS)
    hot = hot.select(*keys, F.ceil(F.col(count) / each).cast("int").alias("__salts"))
    salts = F.coalesce("__salts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("__salts")
    right = totals.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts", count)
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def with_group(rows: DataFrame, keys: list[str], by: list[str], how: str = "inner", salted_rows: int | None = None, **measures: Column) -> DataFrame:
    """Adds aggregates of each key's rows to the rows, as a window over the key would, but without one task per key."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *(m.alias(name) for name, m in measures.items()))
    return salted_join(rows, totals, keys, "__n", by, how, salted_rows)
