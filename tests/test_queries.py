"""Every query that has SQL gives the rows of that SQL; every other one runs."""

from __future__ import annotations

import pytest
from conftest import plain, rows

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if not n.startswith("p") or not n[1:2].isdigit() or n.startswith("p5_")]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in CORE if n in ORACLES])
def test_same_rows_as_sql(spark, duck, data, name):
    mine = QUERIES[name](spark, data)
    other = duck.sql(ORACLES[name])
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    at = [list(other.columns).index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=str)
    found = rows(mine, *columns)
    assert len(found) == len(theirs)
    close = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x)))
    assert all(close(x, y) for a, b in zip(found, theirs) for x, y in zip(a, b))


@pytest.mark.parametrize("name", [n for n in CORE if n not in ORACLES])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["softmax_gap", "binomial_surprise"])
def test_every_directed_pair_has_a_row(spark, data, name):
    from tarn.queries.domain import directed

    key = ["x", "y"] if name == "softmax_gap" else ["table_idx", "x", "y"]
    assert rows(QUERIES[name](spark, data), *key) == rows(directed(spark, data).select(*key).distinct())


@pytest.mark.parametrize("name", ["double_centred", "self_trained"])
def test_every_pair_has_a_row(spark, data, name):
    from tarn.queries.base import pair_stats

    assert rows(QUERIES[name](spark, data), "a", "b") == rows(pair_stats(spark, data).select("a", "b").distinct())


def test_best_lists_shift_every_hand_of_a_pair(spark, data):
    from tarn.queries.domain import class_scores

    sizes = rows(class_scores(spark, data).groupBy("pair_id").count())
    assert max(n for _, n in sizes) > 10 and rows(QUERIES["best_lists"](spark, data).selectExpr("pair_id", "size(shifted)")) == sizes


def test_windows_of_whole_tables_are_bounded(spark, data):
    f = QUERIES["p5_windows"](spark, data)
    assert f.filter("last_1_count < last_7_count").count() > 0 and f.filter("last_1_count > last_7_count").count() == 0 and f.filter("prior_7_count > 0").count() > 0


def test_folds_do_not_cut_tables(spark, data):
    from tarn.queries.domain import model_rows

    assert model_rows(spark, data).groupBy("at").agg({"fold": "min", "fold": "max"}).count() == model_rows(spark, data).select("at", "fold").distinct().count()


def test_impacts_of_a_hand_add_up_to_nothing(spark, data):
    sums = QUERIES["luck_free_impact"](spark, data).groupBy("hand_idx").agg({"impact": "sum"}).toDF("hand_idx", "v")
    assert sums.filter("abs(v) > 1e-6").count() == 0
