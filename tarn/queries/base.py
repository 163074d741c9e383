"""Cleaned tables that the queries share, each as a DataFrame and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.handlog import is_step, seconds
from tarn.sources.tables import table

_HAND = ["table_idx", "hand_seq", "phase", "button_seat", "sb", "bb", "board_cards", "final_pot", "players_dealt", "players_at_showdown"]
_SEAT = ["seat_no", "starting_stack", "c1", "c2", "total_contribution", "net_chips", "folded", "went_to_showdown", "won_share"]
_ACTION = ["street", "player_idx", "action", "amount", "amount_to", "pot_before", "stack_before", "to_call", "players_active"]


def _filled(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key, each column from any copy that has it."""
    return df.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))


def hands(spark: SparkSession, d: str) -> DataFrame:
    """One row per hand with its fields and time `t` in seconds."""
    return _filled(table(spark, d, "hands").withColumn("t", seconds(F.col("ts"))), ["hand_idx"], [*_HAND, "t"])


def seats(spark: SparkSession, d: str) -> DataFrame:
    """One row per seat."""
    return _filled(table(spark, d, "seats"), ["hand_idx", "player_idx"], _SEAT)


def actions(spark: SparkSession, d: str) -> DataFrame:
    """One row per step."""
    return _filled(table(spark, d, "actions").filter(is_step()), ["hand_idx", "action_no"], _ACTION)


def pair_stats(spark: SparkSession, d: str) -> DataFrame:
    """(table_idx, a, b, n, both, flow): for players seated together at a table, hands shared, both at showdown, a lost and b won."""
    s = seats(spark, d).join(hands(spark, d).filter("table_idx is not null").select("hand_idx", "table_idx"), "hand_idx")
    s = s.select("hand_idx", "table_idx", "player_idx", F.coalesce("went_to_showdown", F.lit(False)).alias("sd"), F.coalesce("net_chips", F.lit(0)).alias("net"))
    x, y = s.alias("x"), s.alias("y")
    together = x.join(y, (F.col("x.hand_idx") == F.col("y.hand_idx")) & (F.col("x.player_idx") < F.col("y.player_idx")))
    return together.groupBy(F.col("x.table_idx").alias("table_idx"), F.col("x.player_idx").alias("a"), F.col("y.player_idx").alias("b")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("x.sd") & F.col("y.sd")).cast("bigint")).alias("both"),
        F.sum(((F.col("x.net") < 0) & (F.col("y.net") > 0)).cast("bigint")).alias("flow"),
    )


def _max(columns: list[str]) -> str:
    return ", ".join(f"max({c}) AS {c}" for c in columns)


SECONDS = "CASE WHEN ts IS NULL OR isnan(ts) OR ts = 0 THEN NULL WHEN ts > 1e11 THEN ts / 1000 ELSE ts END"
HANDS = f"h AS (SELECT hand_idx, {_max(_HAND)}, max({SECONDS}) AS t FROM hands WHERE hand_idx IS NOT NULL GROUP BY 1)"
SEATS = f"s AS (SELECT hand_idx, player_idx, {_max(_SEAT)} FROM seats WHERE hand_idx IS NOT NULL AND player_idx IS NOT NULL GROUP BY 1, 2)"
ACTIONS = f"""a AS (SELECT hand_idx, action_no, {_max(_ACTION)} FROM actions WHERE hand_idx IS NOT NULL AND action_no IS NOT NULL
AND player_idx IS NOT NULL AND street BETWEEN 0 AND 3 AND action BETWEEN 0 AND 5 GROUP BY 1, 2)"""
PAIRS = f"""{HANDS}, {SEATS}, sat AS (SELECT s.hand_idx, table_idx, player_idx, coalesce(went_to_showdown, false) AS sd, coalesce(net_chips, 0) AS net
FROM s JOIN h USING (hand_idx) WHERE table_idx IS NOT NULL),
ps AS (SELECT x.table_idx, x.player_idx AS a, y.player_idx AS b, count(*) AS n, CAST(sum((x.sd AND y.sd)::INT) AS BIGINT) AS "both",
CAST(sum((x.net < 0 AND y.net > 0)::INT) AS BIGINT) AS flow FROM sat x JOIN sat y ON x.hand_idx = y.hand_idx AND x.player_idx < y.player_idx GROUP BY 1, 2, 3)"""
