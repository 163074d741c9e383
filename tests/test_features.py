from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from tarn.operators.features import daily_store, feature_table, window_features

SCHEMA = "who int, kind string, t double, id int, v int, count string"


def brute(events, low, high):
    out = {}
    for who, kind, t, i, v, _ in events:
        if None in (who, kind, t):
            continue
        n, total, last = out.get((who, kind), (0, 0, None))
        day = int(t // 86400)
        inside = (low is None or day > low) and (high is None or day <= high)
        out[who, kind] = (n + inside, total + (v or 0) * inside, max(x for x in (last, (t, i if i is not None else -1)) if x is not None))
    return sorted((*k, n, total, last[0], last[1]) for k, (n, total, last) in out.items())


def make(n, seed=3):
    r = random.Random(seed)
    hot = lambda: 0 if r.random() < 0.4 else r.randrange(1, 6)
    return [(hot() if r.random() > 0.05 else None, r.choice(["a", "b", None, "c"]), r.choice([None, 86400.0 * r.randrange(9), 86400 * r.random() * 9]), r.randrange(5), r.choice([None, -3, 4]), "x") for _ in range(n)]


def test_windows_against_brute_force(spark):
    events = make(600)
    store = daily_store(spark.createDataFrame(events, SCHEMA), "who", "kind", "t", "id", "v")
    for low, high in ((None, None), (2, 5), (None, 4), (6, None), (8, 8), (50, 60)):
        f = window_features(store, "who", "kind", {"w": (low, high)})
        found = sorted(tuple(r) for r in f.select("who", "kind", "w_count", "w_total", "latest_time", "latest_ident").collect())
        assert found == brute(events, low, high)


def test_latest_is_the_largest_ident_among_equal_times(spark):
    events = [(1, "a", 5.0, 7, None, ""), (1, "a", 5.0, 9, None, ""), (1, "a", 4.0, 99, None, "")]
    f = window_features(daily_store(spark.createDataFrame(events, SCHEMA), "who", "kind", "t", "id", "v"), "who", "kind", {"w": (None, None)})
    assert rows(f, "latest_ident", "w_count", "w_total") == [(9.0, 3.0, 0.0)]


def test_empty_store_and_entities_without_events(spark):
    store = daily_store(spark.createDataFrame([], SCHEMA), "who", "kind", "t", "id", "v")
    f = window_features(store, "who", "kind", {"w": (None, None)})
    assert f.count() == 0
    entities = spark.createDataFrame([(1,), (1,), (None,), (2,)], "who int")
    wide = feature_table(f.withColumnRenamed("w_count", "count"), entities, "who", "kind", ["a"], ["count", "latest_ident"])
    assert rows(wide, "who", "a_count", "a_latest_ident") == [(1.0, 0.0, None), (2.0, 0.0, None)]


def test_repeated_events_count_as_often_as_they_come(spark):
    e = spark.createDataFrame([(1, "a", 5.0, 7, 2, "")] * 3, SCHEMA).withColumn("day", F.lit("clash")).withColumn("k", F.lit(1))
    f = window_features(daily_store(e, "who", "kind", "t", "id", "v"), "who", "kind", {"w": (None, None)})
    assert rows(f, "w_count", "w_total") == [(3.0, 6.0)]
