"""Skewed joins, cards by tables, the replay of a hand and pair-hand features against plain computations."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from tarn.operators import cards, graph, pairhand, replay, skew


def card(name: str) -> int:
    return cards.RANKS.index(name[0]) * 4 + cards.SUITS.index(name[1])


def hand(names: str) -> list[int]:
    return [card(names[i : i + 2]) for i in range(0, len(names), 2)]


def test_a_key_with_a_third_of_all_rows_is_spread(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 0 else id % 50 end as k").withColumn("__n", F.lit(1))
    totals = df.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.sum("id").alias("total"))
    plain = df.join(totals.drop("c"), "k")
    salted = skew.salted_join(df, totals, ["k"], "c", ["id"], salted_rows=100)
    assert rows(salted, "id", "k", "total") == rows(plain, "id", "k", "total")
    spread = skew.with_group(df.drop("__n"), ["k"], ["id"], salted_rows=100, total=F.sum("id"))
    assert rows(spread, "id", "k", "total") == rows(plain, "id", "k", "total")
    assert skew.salted_join(df.limit(0), totals, ["k"], "c", ["id"]).count() == 0


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "SALTED_ROWS", 10)
    monkeypatch.setattr(skew, "SALTED_ROWS", 10)
    links = spark.range(200).selectExpr("cast(id as int) as r", "case when id < 120 then 'hub' else concat('p', id div 3) end as p")
    found = {r["r"]: r["component"] for r in graph.connected_components(links, "r", "p").collect()}
    assert all(found[i] == 0 for i in range(120)) and all(found[i] == max(120, i - i % 3) for i in range(123, 200))


def test_values_by_tables_are_those_of_the_rules():
    r = np.random.default_rng(3)
    for n in (5, 6, 7):
        x = np.array([r.permutation(52)[:n] for _ in range(4000)])
        assert (cards.values(*(t[x].sum(1) for t in (cards.RANK_SUM, cards.SUIT_SUM, cards.BIT_SUM)), n) == cards.score(x)).all()
    assert cards.describe(cards.score(np.array([hand("AsAhAdKcKd2c3d")]))[0]) == "full house AK"


def test_strength_against_every_other_hand():
    own, board = hand("AhKd"), hand("Ac7d7h2s")
    left = [c for c in range(52) if c not in own + board]
    mine = cards.score(np.array([own + board]))[0]
    others = cards.score(np.array([[*p, *board] for p in combinations(left, 2)]))
    assert abs(cards.strengths(np.array([own]), np.array(board))[0] - ((others < mine).mean() + 0.5 * (others == mine).mean())) < 1e-12
    strength = cards.against_random(1, 2_000)
    assert len(strength) == 169 and strength["AA"] > 0.8 > 0.4 > strength["72o"] and abs(max(cards.top_share(strength).values()) - 1) < 1e-9


def log(spark):
    """One hand: 1 raises, 2 calls, 3 folds before the flop; on the flop 2 bets, 1 folds."""
    hands = spark.createDataFrame([(7, 1, 5, 0, 1, 5, 10, 90, hand("Ts7s2c"), 0.0)], "hand_idx int, table_idx int, hand_seq int, phase tinyint, button_seat tinyint, sb int, bb int, final_pot int, board array<int>, t double")
    seats = [(7, 1, 1, -40, False, 40, *hand("AsAd")), (7, 2, 2, 60, False, 60, *hand("9s8s")), (7, 3, 3, -10, False, 10, *hand("4h4d"))]
    seats = spark.createDataFrame(seats + seats[:1], "hand_idx int, player_idx int, seat_no tinyint, net_chips int, went_to_showdown boolean, total_contribution int, c1 tinyint, c2 tinyint")
    steps = [(7, 1, 0, 1, 4, 30, 10, 15), (7, 2, 0, 2, 2, 30, 30, 45), (7, 3, 0, 3, 0, 0, 20, 75), (7, 4, 1, 2, 3, 40, 0, 75), (7, 5, 1, 1, 0, 0, 40, 115)]
    steps = spark.createDataFrame(steps + steps[1:3], "hand_idx int, action_no smallint, street tinyint, player_idx int, action tinyint, amount int, to_call int, pot_before int")
    return pairhand.hand_rows(hands, seats, steps)


def test_features_of_one_hand(spark):
    h = log(spark)
    d = {(r["x"], r["y"]): r for r in pairhand.directed(pairhand.meetings(h, pairhand.population_rates(h))).collect()}
    assert len(d) == 6
    assert (d[2, 1]["face"], d[2, 1]["call_pre"], d[1, 2]["face"], d[1, 2]["fold_post"]) == (1, 1, 1, 1)
    assert (d[3, 1]["fold_pre"], d[1, 2]["tf"], d[1, 2]["tf_act"], d[1, 3]["tf"]) == (1, 1, 1, 0)
    assert d[1, 2]["both_streets"] == 2 and d[1, 2]["hu_streets"] == 1 and d[1, 2]["hu_checked_streets"] == 0 and d[1, 3]["both_streets"] == 1
    assert d[1, 2]["aggpre"] == 1 and d[1, 2]["fold_after_aggr"] == 1 and d[2, 1]["net_bb"] == 6.0
    pair = {(r["a"], r["b"]): r for r in pairhand.pairs(pairhand.directed(pairhand.meetings(h, pairhand.population_rates(h)))).collect()}
    assert len(pair) == 3 and pair[1, 2]["fpa_role"] == 1 and pair[1, 2]["tf_facing"] == 1 and pair[1, 2]["third_vol"] == 0


def test_replay_of_one_hand(spark):
    r = replay.replay(log(spark)).first()
    acts = {a["k"]: a for a in r["acts"]}
    flop = cards.run_values(np.array([[hand("AsAd"), hand("9s8s"), hand("4h4d")]]), np.array([hand("Ts7s2c")]), 3, np.array([7]))[0]
    assert len(flop) == 43 * 42 // 2  # the third player's cards are out of the deck
    assert np.allclose(acts[4]["eq"][:2], cards.shares(flop, np.array([True, True, False]))) and acts[4]["eq"][2] is None
    assert acts[5]["eqp"] == [None, 1.0, None] and abs(sum(acts[1]["eq"]) - 1) < 1e-9
    assert acts[1]["hs"] is None and 0 < acts[4]["hs"] < 1
    m = pairhand.meetings(replay.replay(log(spark)), pairhand.population_rates(log(spark)), replay.MORE_STEP, replay.MORE_HAND)
    d = {(x["x"], x["y"]): x for x in pairhand.directed(m, True).collect()}
    share = acts[5]["eq"][0]
    assert abs(d[1, 2]["gift"] - max(0, share * 155 - 40) / 10) < 1e-6 and abs(d[1, 2]["max_eq_fold_face"] - share) < 1e-9


def test_unknown_cards_and_empty_logs(spark):
    h = log(spark).withColumn("seats", F.expr("transform(seats, s -> named_struct(" + ", ".join(f"'{f}', {'cast(null as tinyint)' if f == 'c1' else 's.' + f}" for f in ("p", "i", "pos", "net", "sd", "con", "seat_no", "c1", "c2", "cls", "first_no", "fold_no", "vol_no", "aggr_no", "pfr_no", "allin", "fold_st", "first_act", "first_l", "limp_no")) + "))"))
    r = replay.replay(h).first()
    assert all(e is None for a in r["acts"] for e in a["eq"])
    assert pairhand.directed(pairhand.meetings(log(spark).limit(0), pairhand.population_rates(log(spark)))).count() == 0


def test_batched_shares_are_those_of_every_hand_alone():
    r, hands_ = np.random.default_rng(5), []
    for i in range(12):
        deck = r.permutation(52).astype(np.int64)
        hands_.append((deck[:8].reshape(4, 2), deck[8:13]))
    hands_[3][0][1] = -1
    holes, boards = [h for h, _ in hands_], [b for _, b in hands_]
    for known in replay.KNOWN:
        street = replay._Street(known)
        for i in range(12):
            for live in (0b1111, 0b1101, 0b0101):
                street.ask(i, live)
        street.answer(holes, boards, list(range(12)), 50)
        for i in range(12):
            run = cards.run_values(holes[i][None], boards[i][None, :known], known, np.array([i]), 50)[0]
            assert (i, 0b1111) not in street.shares if i == 3 else np.allclose(street.shares[i, 0b1111], cards.shares(run, np.ones(4, bool)))
            assert np.allclose([street.shares[i, 0b0101][s] for s in (0, 2)], cards.shares(run, np.array([True, False, True, False])))
            assert abs(street.alone[i, 0, 2] - ((run[:, 0] > run[:, 2]).mean() + 0.5 * (run[:, 0] == run[:, 2]).mean())) < 1e-9
        if known:
            got = replay._strengths([(i, s) for i in range(12) for s in (0, 3)], holes, boards, known)
            assert all(abs(v - cards.strengths(holes[i][s : s + 1], boards[i][:known])[0]) < 1e-12 for (i, s), v in got.items())
