from __future__ import annotations

import math
from collections import Counter
from itertools import combinations, permutations, product

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.operators import baseline, cards, graph, listing, metrics, models, ordered, pairing, ranking, shaping


def card(name):
    return cards.RANKS.index(name[0]) * 4 + cards.SUITS.index(name[1])


def test_every_five_card_hand():
    hands = np.array(list(combinations(range(52), 5)))
    value = cards.score(hands)
    assert len(np.unique(value)) == 7462
    assert Counter((value // 13**5).tolist()) == {0: 1302540, 1: 1098240, 2: 123552, 3: 54912, 4: 10200, 5: 5108, 6: 3744, 7: 624, 8: 40}


def test_seven_cards_are_their_best_five():
    rng = np.random.default_rng(0)
    hands = np.array([rng.permutation(52)[:7] for _ in range(2000)])
    assert (np.max([cards.score(hands[:, list(k)]) for k in combinations(range(7), 5)], axis=0) == cards.score(hands)).all()


def test_equity_is_the_share_over_all_runouts():
    two = lambda s: (card(s[:2]), card(s[2:]))
    holes, board = [two("AhAd"), two("7c2d"), two("9s8s")], [card(c) for c in ("Ac", "7d", "7h", "Ts")]
    left = [c for c in range(52) if c not in {*board, *(x for h in holes for x in h)}]
    share = np.zeros(3)
    for c in left:
        v = cards.score(np.array([[*h, *board, c] for h in holes]))
        share += (v == v.max()) / (v == v.max()).sum()
    assert np.allclose(cards.equity(holes, board), share / len(left))
    assert abs(cards.equity(holes[:2], [], simulations=4000, seed=1).sum() - 1) < 1e-9


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 6), st.integers(1, 4), st.integers(0, 10**6))
def test_listing_probability_against_enumeration(n, cap, seed):
    rng = np.random.default_rng(seed)
    q, t = rng.random(n), rng.dirichlet([1, 1], n)
    expected = np.zeros(n)
    for event in product([0, 1], repeat=n):
        for kind in product([0, 1], repeat=n):
            p = np.prod([q[i] if event[i] else 1 - q[i] for i in range(n)]) * np.prod([t[i, kind[i]] for i in range(n)])
            for _, i in sorted((kind[i], i) for i in range(n) if event[i])[:cap]:
                expected[i] += p
    assert np.abs(expected - listing.listed_probability(q, t, cap)).max() < 1e-9


def test_lists_from_scores():
    p = np.array([0.9, 0.1, 0.8])
    assert listing.best_order(p, np.outer(p, p), 2) == (0, 2)
    assert listing.greedy_slots(np.array([0.9, 0.8, 0.5]), np.array(["a", "a", "b"]), 2, 0.5) == [0, 2]
    assert abs(listing.logit_shift(np.array([0.2, 0.4, 0.9]), 2.0).sum() - 2) < 1e-6
    rng = np.random.default_rng(1)
    assert abs(listing.censored_poisson_rate(np.minimum(rng.poisson(3.0, 20000), 5)) - 3) < 0.1


def test_greedy_candidates_hold_what_is_picked_among_all():
    rng = np.random.default_rng(3)
    for n in (1, 8, 40):
        for _ in range(30):
            scores, kinds = np.round(rng.random(n), 2), rng.integers(0, 3, n)
            few = listing.greedy_candidates(scores, kinds, 5)
            assert [int(few[i]) for i in listing.greedy_slots(scores[few], kinds[few], 5, 0.6)] == listing.greedy_slots(scores, kinds, 5, 0.6)


def test_best_order_against_enumeration_of_ten():
    rng = np.random.default_rng(4)
    p, together = rng.random(10), rng.random((10, 10))
    value = lambda o: sum((p[i] + sum(together[i, j] for j in o[:r])) / (r + 1) for r, i in enumerate(o))
    assert abs(value(listing.best_order(p, together, 3)) - max(map(value, permutations(range(10), 3)))) < 1e-9


def test_row_index_is_a_permutation_in_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v")
    found = ordered.row_index(df, ["v"]).orderBy("row").collect()
    assert [(r["v"], r["row"]) for r in found] == [(i, i) for i in range(1000)]
    assert ordered.row_index(df.limit(0), ["v"]).count() == 0


def test_session_gap_is_exclusive(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 10.0, 2), (1, 20.1, 3), (2, 5.0, 4), (None, 1.0, 5)], "u int, t double, id int")
    assert rows(ordered.sessions(df, ["u"], "t", ["t", "id"], 10), "id", "session") == [(1.0, 0.0), (2.0, 0.0), (3.0, 1.0), (4.0, 0.0), (5.0, 0.0)]


def test_leave_one_out_and_softmax(spark):
    df = spark.createDataFrame([("x", 1, 1, 2), ("x", 2, 0, 2), ("y", 1, 1, 1)], "x string, y int, hit int, n int")
    out = df.select("x", "y", baseline.leave_one_out(df.hit, df.n, "x").alias("r"))
    assert rows(out) == [("x", 1.0, 0.0), ("x", 2.0, 0.5), ("y", 1.0, None)]
    shares = baseline.softmax_gap(df.withColumn("s", df.hit * 1.0), "x", "s", "y")
    assert {round(r[0], 9) for r in shares.groupBy("x").sum("share").select("sum(share)").collect()} == {1.0}


def test_a_player_all_of_whose_hits_go_to_one_partner_keeps_every_row(spark):
    df = spark.createDataFrame([("x", 1, 40, 40), ("x", 2, 0, 30), ("x", 3, 0, 1), ("y", 1, 1, 1)], "x string, y int, hit int, n int")
    z = baseline.leave_one_out_z(df, "hit", "n")
    out = {(r["x"], r["y"]): r for r in baseline.softmax_gap(z, "x", "z", "y").collect()}
    assert len(out) == 4 and out["x", 1]["z"] > 1000 and out["x", 1]["share"] == 1.0 and out["x", 1]["gap"] > 1000 and out["y", 1]["gap"] is None


def test_poisson_quantile_has_its_rate(spark):
    df = spark.range(4000).select(shaping.uniform("id").alias("u")).selectExpr("u", "3.0D as rate")
    mean = df.select(baseline.poisson_quantile("u", "rate").alias("k")).agg({"k": "avg"}).first()[0]
    assert abs(mean - 3) < 0.15


def test_poisson_quantile_of_large_rates(spark):
    df = spark.range(4000).select(shaping.uniform("id").alias("u")).selectExpr("u", "5000.0D as rate")
    draws = df.select(baseline.poisson_quantile("u", "rate").alias("k")).selectExpr("avg(k)", "stddev(k)").first()
    assert abs(draws[0] - 5000) < 5 and abs(draws[1] - 5000**0.5) < 4
    exact = lambda x, r: next(k for k, c in enumerate(np.cumsum(np.exp([k * np.log(r) - r - math.lgamma(k + 1) for k in range(1200)]))) if c > x)
    assert all(baseline._quantile_near(x, r) == exact(x, r) for x in (0.001, 0.3, 0.5, 0.9999) for r in (601.5, 700.0))


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, f"c{i}") for i in range(60)] + [(i + 1, f"c{i}") for i in range(60)]
    hub = [(i, "hub") for i in range(100, 180)]
    df = spark.createDataFrame(chain + hub + [(500, "own"), (None, "c1"), (7, None), (3, "c3")], "u int, p string")
    found = dict(rows(graph.connected_components(df, "u", "p"), "u", "component"))
    assert found == {float(i): 0.0 for i in range(61)} | {float(i): 100.0 for i in range(100, 180)} | {500.0: 500.0}
    assert graph.connected_components(df.limit(0), "u", "p").count() == 0


def test_band_join_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = [(int(k), int(v)) for k, v in rng.integers(0, 40, (80, 2)) % [3, 40]], [(int(k), int(v)) for k, v in rng.integers(0, 40, (80, 2)) % [3, 40]]
    left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, y int")
    expected = sorted((float(k), float(x), float(y)) for k, x in a for j, y in b if k == j and abs(x - y) <= 2)
    assert sorted(rows(pairing.band_join(left, right, ["k"], "x", "y", 2), "k", "x", "y")) == expected


def test_measures(spark):
    df = spark.createDataFrame([(1, 0.9, True), (2, 0.8, False), (3, 0.8, True), (4, 0.1, False)], "k int, s double, y boolean")
    assert rows(metrics.average_precision(df, "s", "y", "k")) == [(round((1 + 2 / 3) / 2, 5),)]
    assert rows(metrics.roc_auc(df, "s", "y")) == [(0.875,)]
    assert rows(metrics.average_precision(df.filter("not y"), "s", "y", "k")) == [(0.0,)]
    assert metrics.roc_auc(df.limit(0), "s", "y").first()["auc"] is None


def test_bootstrap_agrees_with_the_sign_of_a_clear_difference(spark):
    df = spark.range(300).selectExpr("id", "0.0D as a", "1.0D + id % 3 as b")
    r = metrics.paired_bootstrap(df, "id", "a", "b", 200).first()
    assert r["p_better"] == 1.0 and r["low"] <= r["mean_difference"] <= r["high"]


def test_renormalised_sums_to_one(spark):
    df = spark.createDataFrame([(7,), (5,), (0,), (None,)], "m int")
    from pyspark.sql import functions as F

    parts = shaping.renormalised([F.lit(0.2), F.lit(0.3), F.lit(0.0)], F.col("m"), [1, 2, 4])
    out = [tuple(r) for r in df.select(*parts).collect()]
    assert out[0] == (0.4, 0.6, 0.0) and out[1] == (1.0, 0.0, 0.0) and out[2] == (None, None, None)


def test_union_top_k_keeps_nulls_last(spark):
    df = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, None, 1.0), (1, 3, 1.0, 0.5)], "g int, i int, a double, b double")
    assert rows(ranking.union_top_k(df, ["g"], ["a", "b"], "i", 1), "i") == [(1.0,), (2.0,)]


def test_ridge_logit_recovers_coefficients():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(20000), rng.normal(size=20000)])
    y = (rng.random(20000) < 1 / (1 + np.exp(-(x @ [0.5, -1.0])))).astype(float)
    assert np.allclose(models.ridge_logit(x, y, np.zeros(20000), np.ones(20000), 1.0), [0.5, -1.0], atol=0.08)


def test_binomial_surprise_against_enumeration(spark):
    from math import comb, log

    df = spark.createDataFrame([(3, 9, 0.2), (0, 4, 0.5), (5, 5, 0.1), (None, 4, 0.5)], "h int, n int, p double")
    found = [r[0] for r in df.select(models.binomial_surprise("h", "n", "p")).collect()]
    assert found[3] is None
    for (h, n, p), f in zip([(3, 9, 0.2), (0, 4, 0.5), (5, 5, 0.1)], found):
        assert abs(f + log(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(h, n + 1)))) < 1e-9


def test_equity_at_the_river_splits_ties():
    assert cards.equity([(card("2c"), card("3d")), (card("2h"), card("3s"))], [card(c) for c in ("Ac", "Kc", "Qd", "Jh", "Ts")]).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("kind", ["logistic", "trees"])
def test_cross_fit_separates_held_out_rows(spark, kind):
    df = spark.range(400).selectExpr("id", "cast(id % 2 as double) as label", "cast(id % 2 as double) + rand(1) as x", "cast(id % 3 as int) as fold")
    scored = models.cross_fit(df, ["x"], "fold", 3, "label", kind)
    right = scored.selectExpr("avg(cast((probability[1] > 0.5) = (label = 1) as int))").first()[0]
    assert right > 0.9


def test_rows_without_a_label_are_scored_and_only_they_become_positives(spark):
    df = spark.range(400).selectExpr("id", "if(id % 4 < 2, cast(id % 2 as double), null) as label", "cast(id % 2 as double) + rand(1) as x", "cast(id % 3 as int) as fold", "1.0D as w")
    scored = models.cross_fit(df, ["x"], "fold", 3, "label", "logistic", "w").selectExpr("*", "probability[1] as p")
    assert scored.count() == 400
    flipped = scored.withColumn("p", scored.p * 0 + 0.9)
    extra = models.pseudo_positives(flipped, "p", "label", "w", 0.2)
    assert {tuple(r) for r in extra.selectExpr("id % 4", "label", "w").distinct().collect()} == {(2, 1.0, 0.2), (3, 1.0, 0.2)}
