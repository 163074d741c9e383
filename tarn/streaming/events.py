"""Streams of events: windows, sessions, repeats and per-key state, under Structured Streaming.

A stream is run over what its folder holds now (trigger availableNow) and can be started again from its checkpoint, which
lies in the shared folder, as do results; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.sources.io import scratch


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of a data folder as a stream of its files; the schema comes from the files' footers."""
    path = f"{folder}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over the present input; the result as a table. Complete results replace one another, others add up."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    table = spark.read.parquet(out)
    return table.drop("batch") if mode != "complete" else table


def windowed(stream: DataFrame, time: str, key: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """(start, key, n, total) of sliding windows; events later than `late` behind the newest are dropped."""
    w = F.window(time, length, slide)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def session_windows(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, n) of sessions that end after `gap` without an event."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def without_repeats(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key; a key is forgotten `late` after its event."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def latest_of_kind(stream: DataFrame, key: str, ident: str, time: str, kind: str, wanted: str) -> DataFrame:
    """(key, latest, n): each key's latest event of a kind by time and how many there were, kept as state of two numbers and a time."""
    chosen = stream.filter(F.col(kind) == wanted).select(F.col(key).alias("k"), F.col(ident).alias("i"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, i, n = state.get if state.exists else (-1, -1, 0)
        for frame in frames:
            n += len(frame)
            last = frame.sort_values(["t", "i"]).iloc[-1]
            t, i = max((t, i), (int(last["t"]), int(last["i"])))
        state.update((t, i, n))
        yield pd.DataFrame({"k": [k[0]], "latest": [i], "n": [n]})

    out = chosen.groupBy("k").applyInPandasWithState(update, "k bigint, latest bigint, n bigint", "t bigint, i bigint, n bigint", "update", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("k", key)
