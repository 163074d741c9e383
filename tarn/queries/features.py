"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.features import DAY, daily_store, feature_table, window_features
from tarn.sources.handlog import ACTIONS, STREETS, hand_times, is_step
from tarn.sources.tables import table

TYPES = [f"s{s}_a{a}" for s in STREETS for a in ACTIONS] + ["net_neg", "net_zero", "net_pos"]


#: Bits of a packed step below the player: action_no, then street * 6 + action. A packed seat has net_chips there.
NO_BITS, CODE_BITS, NET_BITS = 16, 5, 32


def player_events(spark: SparkSession, d: str) -> DataFrame:
    """(player_idx, code, time, hand_idx, net): the steps and the seats' results in hands with a time; code is a place in TYPES.

    Steps and seats go to their hand in one exchange, as a set of packed numbers, so copies vanish before it; there the hand's
    time is found without another.
    """
    player = F.col("player_idx").cast("bigint")
    step = F.shiftleft(player, NO_BITS + CODE_BITS) + F.shiftleft(F.col("action_no").cast("bigint").bitwiseAND(2**NO_BITS - 1), CODE_BITS) + F.col("street") * len(ACTIONS) + F.col("action")
    acted = table(spark, d, "actions").filter(is_step()).select("hand_idx", step.alias("step"), F.lit(None).cast("bigint").alias("seat"))
    seat = F.shiftleft(player, NET_BITS) + F.col("net_chips").cast("bigint").bitwiseAND(2**NET_BITS - 1)
    results = table(spark, d, "seats").filter("hand_idx is not null and player_idx is not null and net_chips is not null").select("hand_idx", F.lit(None).cast("bigint").alias("step"), seat.alias("seat"))
    hands = acted.unionByName(results).groupBy("hand_idx").agg(F.collect_set("step").alias("steps"), F.collect_set("seat").alias("seats"))
    code = lambda x: x.bitwiseAND(2**CODE_BITS - 1).cast("tinyint")
    own = lambda who, code, net: F.struct(who.cast("int").alias("player_idx"), code.alias("code"), net.alias("net"))
    # Dropping the upper bits first and shifting back keeps the sign of net_chips.
    net = lambda x: F.shiftright(F.shiftleft(x, 64 - NET_BITS), 64 - NET_BITS).cast("int")
    sign = lambda x: (F.signum(net(x)) + len(STREETS) * len(ACTIONS) + 1).cast("tinyint")
    every = F.concat(
        F.transform("steps", lambda x: own(F.shiftright(x, NO_BITS + CODE_BITS), code(x), F.lit(None).cast("int"))),
        F.transform("seats", lambda x: own(F.shiftright(x, NET_BITS), sign(x), net(x))),
    )
    timed = hands.join(hand_times(table(spark, d, "hands")), "hand_idx")
    return timed.select("hand_idx", "time", F.explode(every).alias("e")).select("e.player_idx", "e.code", "time", "hand_idx", "e.net")


def span(spark: SparkSession, d: str) -> tuple[int | None, int | None]:
    """First and last day of any hand, from the hands alone."""
    day = F.floor(F.col("time") / DAY).cast("int")
    return tuple(hand_times(table(spark, d, "hands")).agg(F.min(day), F.max(day)).first())


def type_name() -> Column:
    return F.get(F.array(*(F.lit(t) for t in TYPES)), F.col("code")).alias("event_type")


def store(spark: SparkSession, d: str) -> DataFrame:
    return daily_store(player_events(spark, d), "player_idx", "code", "time", "hand_idx", "net")


#: Windows of the feature table: (days before the last day that the window begins after, and that it ends with).
WINDOWS = {"last_1": (1, 0), "last_7": (7, 0), "prior_7": (14, 7)}


def windows(last: int | None) -> dict[str, tuple[int | None, int | None]]:
    return {w: (None, None) if last is None else (last - n, last - m) for w, (n, m) in WINDOWS.items()}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Types of which a player has three events or more: the counts of the older and the newer half of the log together."""
    first, last = span(spark, d)
    middle = None if last is None else (first + last) // 2
    features = window_features(store(spark, d), "player_idx", "code", {"older": (None, middle), "newer": (middle, last)})
    several = features.filter(F.col("older_count") + F.col("newer_count") >= 3)
    return several.select("player_idx", type_name(), F.col("latest_ident").alias("last_hand_idx"))


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per player of the seats: for every type the count and the latest hand, and the counts of three windows, in all
    hands with a time; and the totals of net_chips over all and over the windows."""
    inside = windows(span(spark, d)[1])
    features = window_features(store(spark, d), "player_idx", "code", {"all": (None, None)} | inside).select(
        "player_idx", type_name(), F.col("all_count").alias("count"), F.col("latest_ident").alias("latest_hand"), F.col("all_total").alias("total"),
        *(F.col(f"{w}_{m}") for w in inside for m in ("count", "total")),
    )
    measures = ["count", "latest_hand", *(f"{w}_count" for w in inside)]
    wide = feature_table(features, table(spark, d, "seats"), "player_idx", "event_type", TYPES, [*measures, "total", *(f"{w}_total" for w in inside)])
    nets = lambda m: sum(F.col(f"net_{s}_{m}") for s in ("neg", "zero", "pos")).cast("bigint").alias(f"net_chips_{m}")
    return wide.select("player_idx", *(f"{t}_{m}" for t in TYPES for m in measures), nets("total"), *(nets(f"{w}_total") for w in inside))


def p5_windows(spark: SparkSession, d: str) -> DataFrame:
    """Count and total of every player and type in each of the windows, in long form."""
    inside = windows(span(spark, d)[1])
    return window_features(store(spark, d), "player_idx", "code", inside).select("player_idx", type_name(), *(f"{w}_{m}" for w in inside for m in ("count", "total")))


QUERIES = {"p5_found": p5_found, "p5_features": p5_features, "p5_windows": p5_windows}

_SECONDS = "CASE WHEN ts IS NULL OR isnan(ts) OR ts = 0 THEN NULL WHEN ts > 1e11 THEN ts / 1000 ELSE ts END"
_EVENTS = f"""
WITH times AS (SELECT hand_idx, max({_SECONDS}) AS t FROM hands WHERE {_SECONDS} IS NOT NULL GROUP BY 1),
steps AS (SELECT DISTINCT hand_idx, action_no, player_idx, street, action FROM actions
          WHERE player_idx IS NOT NULL AND street BETWEEN 0 AND 3 AND action BETWEEN 0 AND 5 AND action_no IS NOT NULL),
seated AS (SELECT hand_idx, player_idx, max(net_chips) AS net FROM seats WHERE player_idx IS NOT NULL GROUP BY 1, 2),
ev AS (SELECT hand_idx, player_idx, 's' || street || '_a' || action AS k, NULL AS net FROM steps
       UNION ALL SELECT hand_idx, player_idx, CASE WHEN net < 0 THEN 'net_neg' WHEN net = 0 THEN 'net_zero' ELSE 'net_pos' END, net
       FROM seated WHERE net IS NOT NULL),
last AS (SELECT player_idx, k, count(*) AS n, sum(net) AS total, arg_max(hand_idx, struct_pack(t := t, h := hand_idx)) AS h
         FROM ev JOIN times USING (hand_idx) GROUP BY 1, 2)
"""
_DATED = """, dated AS (SELECT player_idx, k, net, CAST(floor(t / 86400) AS BIGINT) AS day FROM ev JOIN times USING (hand_idx)),
z AS (SELECT max(CAST(floor(t / 86400) AS BIGINT)) AS z FROM times)"""


def _inside(after: int, until: int) -> str:
    return f"count(*) FILTER (day > z - {after} AND day <= z - {until})"


ORACLES = {
    "p5_found": _EVENTS + "SELECT player_idx, k AS event_type, h AS last_hand_idx FROM last WHERE n >= 3",
    "p5_features": _EVENTS
    + _DATED
    + ", w AS (SELECT player_idx, k, "
    + ", ".join(f"{_inside(n, m)} AS {w}_count, coalesce(sum(net) FILTER (day > z - {n} AND day <= z - {m}), 0) AS {w}_total" for w, (n, m) in WINDOWS.items())
    + " FROM dated, z GROUP BY 1, 2), j AS (SELECT * FROM last JOIN w USING (player_idx, k)) SELECT p.player_idx, "
    + ", ".join(
        f"CAST(coalesce(max(n) FILTER (k = '{t}'), 0) AS BIGINT) AS {t}_count, max(h) FILTER (k = '{t}') AS {t}_latest_hand, "
        + ", ".join(f"CAST(coalesce(max({w}_count) FILTER (k = '{t}'), 0) AS BIGINT) AS {t}_{w}_count" for w in WINDOWS)
        for t in TYPES
    )
    + ", CAST(coalesce(sum(total), 0) AS BIGINT) AS net_chips_total, "
    + ", ".join(f"CAST(coalesce(sum({w}_total), 0) AS BIGINT) AS net_chips_{w}_total" for w in WINDOWS)
    + " FROM (SELECT DISTINCT player_idx FROM seats WHERE player_idx IS NOT NULL) p LEFT JOIN j ON p.player_idx = j.player_idx GROUP BY 1",
    "p5_windows": _EVENTS
    + _DATED
    + " SELECT player_idx, k AS event_type, "
    + ", ".join(f"{_inside(n, m)} AS {w}_count, CAST(coalesce(sum(net) FILTER (day > z - {n} AND day <= z - {m}), 0) AS BIGINT) AS {w}_total" for w, (n, m) in WINDOWS.items())
    + " FROM dated, z GROUP BY 1, 2",
}
