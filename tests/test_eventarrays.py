"""The array engine against the operators that spread over tasks, and its conditions against SQL's nulls."""

from __future__ import annotations

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from tarn.operators import eventarrays, handarrays, pairhand
from tarn.queries import analyses
from tarn.queries import pairhand as Q


def test_conditions_have_nulls_and_exact_decimals():
    three = np.array([True, True, False])
    f = handarrays.Frame({"a": (np.array([63, 62, 5]), three), "pot": (np.array([180, 180, 9]), True), "b": (np.array([True, False, True]), three), "s": (True, True)}, 3)
    holds = lambda sql: np.broadcast_to(f.holds(sql), 3).tolist()
    assert holds("a <= 0.35 * pot") == [True, True, False] and holds("NOT (a <= 0.35 * pot)") == [False] * 3
    assert holds("b OR pot = 9") == [True, False, True] and holds("NOT b") == [False, True, False] and holds("NOT (b AND pot = 9)") == [True, True, False]
    assert holds("s AND gone > 1") == [False] * 3 and holds("NOT gone OR s") == [True] * 3
    assert holds("(a - pot + 6) % 6 = -3") == [True, False, False] and holds("a IN (5, 62)") == [False, True, False] and holds("pot BETWEEN 9 AND 10") == [False, False, True]


def test_scores_of_a_table_need_one_exchange_of_hands_and_no_window(spark, data):
    plan = Q.multi_event_scores(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Scan ExistingRDD" not in plan


def test_large_tables_are_spread_and_score_the_same(spark, data, monkeypatch):
    whole = rows(Q.multi_event_scores(spark, data))
    sizes = [r["count"] for r in Q.whole_hands(spark, data).filter("table_idx is not null").groupBy("table_idx").count().collect()]
    monkeypatch.setattr(eventarrays, "HOT_HANDS", sorted(sizes)[len(sizes) // 2])
    monkeypatch.setattr(eventarrays, "TOGETHER", 1)
    hot = eventarrays.hot_tables(Q.whole_hands(spark, data))
    assert 0 < len(hot) < len(sizes) and rows(Q.multi_event_scores(spark, data)) == whole and len(whole) > 100


def test_excess_is_that_of_the_operators_that_spread(spark, data, monkeypatch):
    plain = Q.event_excess(spark, data)
    assert "Window" not in plain._jdf.queryExecution().executedPlan().toString()
    whole = rows(plain)
    monkeypatch.setattr(eventarrays, "HOT_HANDS", 0)
    assert rows(Q.event_excess(spark, data)) == whole and len(whole) > 30


def test_pairs_on_arrays_are_those_of_the_operators(spark, data):
    engine = Q.pair_hand_engine(spark, data)
    plan = engine._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Scan ExistingRDD" not in plan and "Generate" not in plan.split("MapInArrow")[0]
    plain = pairhand.pairs(pairhand.directed(Q.met_open(spark, data), True), True)
    assert engine.schema.simpleString() == plain.schema.simpleString()
    assert rows(engine) == rows(plain)


def test_values_of_expressions_are_those_of_sql(spark):
    """NULLs, decimals, CASE and conditions as numbers."""
    data = [(1, 2, 0.5, True), (None, -3, None, False), (4, None, 0.25, None), (-1, 7, 0.75, True)]
    columns = {c: (np.array([0 if r[i] is None else r[i] for r in data]), np.array([r[i] is not None for r in data])) for i, c in enumerate("abcd")}
    sql = [
        "CAST(a AS DOUBLE) / b", "greatest(a, b)", "least(-a, b)", "CASE WHEN a < b THEN 1 WHEN d THEN c END", "CAST(d AND a > 0 AS INT)", "CAST(coalesce(a <> 1, true) AS INT)", "coalesce(a, 99) - b",
        "CASE WHEN a IS NULL OR b IS NULL THEN 0.5 ELSE (a + 3) % 6 END", "CAST(NOT (b IS NOT NULL AND c >= 0.25) AS INT)",
    ]
    f = handarrays.Frame(columns, 4)
    got = list(zip(*([float(x) if ok else None for x, ok in zip(v, np.broadcast_to(filled, 4))] for v, filled in map(f.value, sql))))
    wanted = spark.createDataFrame(data, "a int, b int, c double, d boolean").coalesce(1).select(*(F.expr(e).cast("double") for e in sql)).collect()
    assert got == [tuple(r) for r in wanted]


def test_orientation_is_that_of_the_engines_rows(spark, data):
    oriented = analyses.oriented_features(spark, data)
    # The tasks that replay hands give the final columns; nothing but the write is left for rows of 160 columns.
    assert oriented._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0].count("Project") == 0
    engine = Q.pair_hand_engine(spark, data).withColumn("donor", F.expr(analyses._DONOR))
    from_a, names = F.col("donor") == "a", [c[:-3] for c in engine.columns if c.endswith("_ab")]
    sides = {"max": lambda x, y: F.greatest(x, y), "min": lambda x, y: F.least(x, y), "donor": lambda x, y: F.when(from_a, x).otherwise(y), "receiver": lambda x, y: F.when(from_a, y).otherwise(x)}
    plain = engine.select("hand_idx", "a", "b", "donor", *(f(F.col(f"{c}_ab"), F.col(f"{c}_ba")).alias(f"{c}_{n}") for c in names for n, f in sides.items()))
    assert oriented.schema.simpleString() == plain.schema.simpleString()
    assert rows(oriented) == rows(plain)


def test_signatures_are_those_of_the_engines_rows(spark, data):
    fast, plain = Q.pair_signatures_open(spark, data), pairhand.pair_signatures(Q.pair_hand_engine(spark, data), ["a", "b"], True)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    # A row goes to its pair as one number of flags and six sums, not as 56 counts.
    assert "flags" in plan and "partial_sum(CASE" not in plan and "HashAggregate(keys=[a" not in plan
    assert fast.schema.simpleString() == plain.schema.simpleString()
    got, wanted = (sorted(map(tuple, x.collect())) for x in (fast, plain))
    assert len(got) == len(wanted) > 100 and all(x[:3] == y[:3] and np.allclose(np.array(x[3:], float), np.array(y[3:], float), 1e-9, 1e-9, equal_nan=True) for x, y in zip(got, wanted))
