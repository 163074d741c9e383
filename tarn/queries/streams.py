"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.streaming import events as S


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    out = S.run_to_end(S.windowed(_events(spark, d), "ts", "event_type", "value", "2 days", "1 day", "30 days"), "complete")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = S.run_to_end(S.session_windows(_events(spark, d), "ts", "user_id", "1 hour", "30 days"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


def stream_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return S.run_to_end(S.without_repeats(_events(spark, d), "ts", ["event_id"], "30 days"), "append").select("event_id")


def stream_latest_purchase(spark: SparkSession, d: str) -> DataFrame:
    """The last state of every user; states come as they change, so the one with the highest count is the last."""
    out = S.run_to_end(S.latest_of_kind(_events(spark, d), "user_id", "event_id", "ts", "event_type", "purchase"), "update")
    return out.groupBy("user_id").agg(F.max_by("latest", "n").alias("latest"), F.max("n").alias("n"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions, stream_without_repeats, stream_latest_purchase)}
ORACLES = {
    "stream_windows": "WITH w AS (SELECT event_type, value, unnest([0, 1]) AS back, epoch(date_trunc('day', ts))::BIGINT AS day FROM events) SELECT CAST(day - 86400 * back AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_without_repeats": "SELECT DISTINCT event_id FROM events",
    "stream_latest_purchase": "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS latest, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1",
}
