"""One row per entity from events of many types, out of a store of daily running totals.

The store holds, for each entity, event type and day with an event, the count and total up to and including that day, and
the latest event so far. A window's features are its end's entry less its start's, both found as of the day, so any number
of windows is read from one store without touching the events again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def daily_store(events: DataFrame, entity: str, kind: str, time: str, ident: str, value: str) -> DataFrame:
    """(entity, kind, day, count, total, latest_time, latest_ident): running over the days of an entity and type.

    time is in epoch seconds; value may be null, which adds nothing. Rows with a null entity, type or time do not count.
    Among events of one time the largest ident is the latest. Repeated rows count as often as they come. Other columns are
    ignored; an empty input gives an empty store.

    Events are added up by entity, type and day before the shuffle, so a hot entity costs as many rows as it has days.
    """
    per_day = (
        events.select(
            F.col(entity).alias("e"), F.col(kind).alias("k"), F.floor(F.col(time) / DAY).cast("int").alias("day"),
            F.struct(F.col(time).alias("t"), F.col(ident).alias("i")).alias("at"), F.col(value).cast("bigint").alias("v"),
        )
        .filter(F.col("e").isNotNull() & F.col("k").isNotNull() & F.col("day").isNotNull())
        .groupBy("e", "k", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.max("at").alias("at"))
    )
    return running(per_day).select(
        F.col("e").alias(entity), F.col("k").alias(kind), "day", "count", "total", "latest_time", "latest_ident"
    )


def running(per_day: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("e", "k").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(
        "e", "k", "day",
        F.sum("n").over(so_far).alias("count"),
        F.coalesce(F.sum("v").over(so_far), F.lit(0)).alias("total"),
        F.max("at").over(so_far)["t"].alias("latest_time"),
        F.max("at").over(so_far)["i"].alias("latest_ident"),
    )


def as_of(column: str, day: int | None) -> Column:
    """Aggregate: the running value at the end of a day, 0 if nothing came before; None is the end of the store."""
    known = F.lit(True) if day is None else F.col("day") <= day
    return F.coalesce(F.max_by(F.when(known, F.col(column)), F.when(known, F.col("day"))), F.lit(0))


def window_features(store: DataFrame, entity: str, kind: str, windows: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """(entity, kind, latest_time, latest_ident, and per window <name>_count, <name>_total): one row per entity and type.

    A window is (after, until): the days > after and <= until; None is the store's start or end. Windows without an event
    give 0. latest_time and latest_ident are over the whole store.
    """
    columns = []
    for name, (after, until) in windows.items():
        for column in ("count", "total"):
            start = F.lit(0) if after is None else as_of(column, after)
            columns.append((as_of(column, until) - start).alias(f"{name}_{column}"))
    return store.groupBy(entity, kind).agg(
        F.max_by("latest_time", "day").alias("latest_time"), F.max_by("latest_ident", "day").alias("latest_ident"), *columns
    )


def feature_table(features: DataFrame, entities: DataFrame, entity: str, kind: str, kinds: list[str], measures: list[str]) -> DataFrame:
    """One row per entity of `entities` (its null and repeated keys do not count), with <type>_<measure> columns.

    Types are named beforehand, so the width is fixed and no scan is spent on finding them; a type an entity never had
    gives 0 for counts and totals and null for the latest event. Written as conditional aggregates, with one shuffle.
    """
    columns = []
    for k in kinds:
        for m in measures:
            value = F.max(F.when(F.col(kind) == k, F.col(m)))
            columns.append((value if m.startswith("latest") else F.coalesce(value, F.lit(0))).alias(f"{k}_{m}"))
    keys = entities.select(entity).filter(F.col(entity).isNotNull()).distinct()
    return keys.join(features, entity, "left").groupBy(entity).agg(*columns)
