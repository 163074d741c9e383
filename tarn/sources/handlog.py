"""The hand log with its dirt removed: steps, seats, and each hand's table and time.

Copies are aggregated away before a shuffle, so a hand sent a million times costs one row a task. Tables and times have one
row per hand and are evenly hashed; joins on hand_idx build their hash maps from them and spare the sort of the log.

Copies of a row never contradict each other in a filled field, so a filled value is taken from any copy. All functions
accept extra columns, empty tables and nulls in any column; rows without the identifying fields do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of the log.
STREETS = range(4)
ACTIONS = range(6)
MILLISECONDS_FROM = 1e11


def is_step() -> Column:
    """True for rows that name a step: filled hand, number and player, a street in 0-3 and an action in 0-5."""
    return (
        F.col("hand_idx").isNotNull()
        & F.col("action_no").isNotNull()
        & F.col("player_idx").isNotNull()
        & F.col("street").between(STREETS[0], STREETS[-1])
        & F.col("action").between(ACTIONS[0], ACTIONS[-1])
    )


def steps(actions: DataFrame) -> DataFrame:
    """One row per step (hand_idx, action_no, player_idx, street, action); copies count once."""
    return actions.filter(is_step()).groupBy("hand_idx", "action_no").agg(
        F.max("player_idx").alias("player_idx"), F.max("street").alias("street"), F.max("action").alias("action")
    )


def seat_rows(seats: DataFrame) -> DataFrame:
    """One row per seat (hand_idx, player_idx) with its filled net_chips, null if no copy has it."""
    return (
        seats.filter(F.col("hand_idx").isNotNull() & F.col("player_idx").isNotNull())
        .groupBy("hand_idx", "player_idx")
        .agg(F.max("net_chips").alias("net_chips"))
    )


def seconds(ts: Column) -> Column:
    """Epoch seconds; larger values are milliseconds; null, NaN or 0 is no time."""
    good = F.when(~F.isnan(ts) & (ts != 0), ts)
    return F.when(good > MILLISECONDS_FROM, good / 1000).otherwise(good)


def hand_tables(hands: DataFrame) -> DataFrame:
    """(hand_idx, table_idx) of the hands with a table."""
    return (
        hands.filter(F.col("hand_idx").isNotNull() & F.col("table_idx").isNotNull())
        .groupBy("hand_idx")
        .agg(F.max("table_idx").alias("table_idx"))
        .hint("shuffle_hash")
    )


def hand_times(hands: DataFrame) -> DataFrame:
    """(hand_idx, time) of the hands with a time, in epoch seconds."""
    return (
        hands.select("hand_idx", seconds(F.col("ts")).alias("time"))
        .filter(F.col("hand_idx").isNotNull() & F.col("time").isNotNull())
        .groupBy("hand_idx")
        .agg(F.max("time").alias("time"))
        .hint("shuffle_hash")
    )
