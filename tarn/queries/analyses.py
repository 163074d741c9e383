"""Further analyses of the hand log: cards, detectors, rates, measures and checks, each with its SQL where there is one."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tarn.operators import baseline as B
from tarn.operators import cards, models, pairarrays, ranking
from tarn.operators import pairhand as P
from tarn.operators.handarrays import Frame
from tarn.plans.lineage import cut
from tarn.queries import domain as D
from tarn.queries import evidence as V
from tarn.queries import pairhand as Q
from tarn.queries.base import HANDS, SEATS, hands, seats
from tarn.queries.domain import _LABELLED, _PAIRHAND, _SC, class_scores, labelled, listed, pair_hands
from tarn.queries.relational import R6
from tarn.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Cards

_RANK = "list_transform(cards, lambda c: CAST(c // 4 AS INTEGER))"
_OF = lambda n: f"list_reverse_sort(list_filter(range(13), lambda r: counts[r + 1] >= {n}))"
_HIGH = lambda e: f"coalesce(list_max({e}), -1)"
_LINE = lambda e: f"coalesce(list_max(list_filter(range(3, 13), lambda t: list_has_all({e}, CASE WHEN t = 3 THEN [0, 1, 2, 3, 12] ELSE [t - 4, t - 3, t - 2, t - 1, t] END))), -1)"
_PACK = lambda e, n: f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_resize(({e})[1:{n}], {n}, CAST(0 AS BIGINT))), lambda a, b: a * 13 + b)"
#: Value of five to seven `cards`, by the rules of poker, in steps of sets of ranks.
_VALUED = f"""c1_ AS (SELECT *, list_transform(range(13), lambda r: len(list_filter({_RANK}, lambda x: x = r))) AS counts, list_transform(range(4), lambda s: list_reverse_sort(list_transform(list_filter(cards, lambda c: c % 4 = s), lambda c: CAST(c // 4 AS BIGINT)))) AS suited FROM held),
c2_ AS (SELECT *, {_OF(1)} AS ones, {_OF(2)} AS twos, {_OF(3)} AS threes, {_OF(4)} AS fours, coalesce(list_filter(suited, lambda s: len(s) >= 5)[1], []) AS flush FROM c1_),
c3_ AS (SELECT *, {_LINE('ones')} AS line, {_LINE('flush')} AS royal, coalesce(list_filter(twos, lambda r: r <> threes[1])[1], -1) AS pairs FROM c2_),
valued AS (SELECT *, CASE WHEN royal >= 0 THEN 8 * 371293 + royal WHEN len(fours) > 0 THEN 7 * 371293 + fours[1] * 13 + list_filter(ones, lambda r: r <> fours[1])[1] WHEN len(threes) > 0 AND pairs >= 0 THEN 6 * 371293 + threes[1] * 13 + pairs
WHEN len(flush) > 0 THEN 5 * 371293 + {_PACK('flush', 5)} WHEN line >= 0 THEN 4 * 371293 + line WHEN len(threes) > 0 THEN 3 * 371293 + threes[1] * 169 + {_PACK('list_filter(ones, lambda r: r <> threes[1])', 2)}
WHEN len(twos) > 1 THEN 2 * 371293 + twos[1] * 169 + twos[2] * 13 + list_filter(ones, lambda r: r <> twos[1] AND r <> twos[2])[1] WHEN len(twos) = 1 THEN 371293 + twos[1] * 2197 + {_PACK('list_filter(ones, lambda r: r <> twos[1])', 3)} ELSE {_PACK('ones', 5)} END AS value FROM c3_)"""
_BOARD = "bd AS (SELECT hand_idx, max(board) AS board FROM hands WHERE hand_idx IS NOT NULL GROUP BY 1)"
_STRENGTH = f"""WITH {SEATS}, {_BOARD}, held AS (SELECT s.hand_idx, s.player_idx, n, list_concat([CAST(c1 AS INTEGER), CAST(c2 AS INTEGER)], list_transform(board[1:n], lambda b: CAST(b AS INTEGER))) AS cards FROM s JOIN bd USING (hand_idx), (VALUES (3), (4), (5)) v(n) WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND len(board) >= n),
{_VALUED}, lastb AS (SELECT *, max(n) OVER (PARTITION BY hand_idx) AS last FROM valued), ranked AS (SELECT *, rank() OVER (PARTITION BY hand_idx, n ORDER BY value DESC) - 1 AS better, count(*) OVER (PARTITION BY hand_idx, n, value) - 1 AS tied FROM lastb),
fo AS (SELECT hand_idx, player_idx, min(street) AS fold_street FROM actions WHERE hand_idx IS NOT NULL AND action_no IS NOT NULL AND player_idx IS NOT NULL AND street BETWEEN 0 AND 3 AND action = 0 GROUP BY 1, 2)
SELECT s.hand_idx, s.player_idx, """ + ", ".join(f"CAST(max(value) FILTER (n = {n}) AS BIGINT) AS {w}" for n, w in ((3, "flop"), (4, "turn"), (5, "river"))) + ", " + ", ".join(f"CAST(max(value // 371293) FILTER (n = {n}) AS INTEGER) AS {w}_category" for n, w in ((3, "flop"), (4, "turn"), (5, "river"))) + """,
CAST(max(better) FILTER (n = 5) AS INTEGER) AS better, CAST(max(tied) FILTER (n = 5) AS INTEGER) AS tied, CAST(max(better) FILTER (n = last) AS INTEGER) AS better_last, CAST(max(last) AS INTEGER) AS last_board, coalesce(max(better) FILTER (n = last) = 0, false) AS best_last, CAST(any_value(fold_street) AS INTEGER) AS fold_street
FROM s JOIN bd USING (hand_idx) LEFT JOIN ranked r ON r.hand_idx = s.hand_idx AND r.player_idx = s.player_idx LEFT JOIN fo ON fo.hand_idx = s.hand_idx AND fo.player_idx = s.player_idx WHERE c1 IS NOT NULL AND c2 IS NOT NULL GROUP BY 1, 2"""


def valued_seats(spark: SparkSession, d: str) -> DataFrame:
    """Seats with known cards and the values of their hands on flop, turn and river."""
    board = table(spark, d, "hands").filter("hand_idx is not null").groupBy("hand_idx").agg(F.max("board").alias("board"))
    known = seats(spark, d).filter("c1 is not null and c2 is not null").select("hand_idx", "player_idx", "c1", "c2").join(board.filter("board is not null"), "hand_idx")
    return known.withColumn("v", cards.street_values("c1", "c2", *(F.get("board", F.lit(i)) for i in range(5))))


@query(_STRENGTH)
def seat_strength(spark: SparkSession, d: str) -> DataFrame:
    """Value and category of each known hand on flop, turn and river, how many at the table have a better or equal one on the
    river and on the last board, and the street of the fold."""
    v = valued_seats(spark, d).select("hand_idx", "player_idx", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("flop", "turn", "river"))))
    v = v.withColumns({"last": F.coalesce("river", "turn", "flop"), "last_board": F.when(F.col("river").isNotNull(), 5).when(F.col("turn").isNotNull(), 4).when(F.col("flop").isNotNull(), 3)})
    w = Window.partitionBy("hand_idx")
    better = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(w.orderBy(F.col(c).desc_nulls_last())) - 1).cast("int")
    tied = F.when(F.col("river").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("hand_idx", "river")) - 1).cast("int")
    v = v.withColumns({"better": better("river"), "tied": tied, "better_last": better("last")}).withColumn("best_last", F.coalesce(F.col("better_last") == 0, F.lit(False)))
    folds = Q.table(spark, d, "actions").filter(Q.is_step() & (F.col("action") == 0)).groupBy("hand_idx", "player_idx").agg(F.min("street").cast("int").alias("fold_street"))
    categories = {f"{c}_category": F.floor(F.col(c) / 13**5).cast("int") for c in ("flop", "turn", "river")}
    return v.withColumns(categories).drop("last").join(folds, ["hand_idx", "player_idx"], "left")


@query()
def described_hands(spark: SparkSession, d: str) -> DataFrame:
    """The last hand of every seat with known cards, in words."""
    v = valued_seats(spark, d).select("hand_idx", "player_idx", F.coalesce(*(F.get("v", F.lit(i)) for i in (2, 1, 0))).alias("value")).filter("value is not null")
    return v.select("hand_idx", "player_idx", "value", cards.described("value").alias("hand"))


_HI, _LO = "greatest(c1 // 4, c2 // 4)", "least(c1 // 4, c2 // 4)"
_NAME = f"substr('23456789TJQKA', CAST({_HI} AS INTEGER) + 1, 1) || substr('23456789TJQKA', CAST({_LO} AS INTEGER) + 1, 1) || CASE WHEN c1 // 4 = c2 // 4 THEN '' WHEN c1 % 4 = c2 % 4 THEN 's' ELSE 'o' END"
_POINTS = f"CASE {_HI} WHEN 12 THEN 10 WHEN 11 THEN 8 WHEN 10 THEN 7 WHEN 9 THEN 6 ELSE ({_HI} + 2) / 2 END"
_CHEN = f"ceil(CASE WHEN c1 // 4 = c2 // 4 THEN greatest(2 * {_POINTS}, 5) ELSE {_POINTS} + CASE WHEN c1 % 4 = c2 % 4 THEN 2 ELSE 0 END - CASE {_HI} - {_LO} WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 5 END + CASE WHEN {_HI} - {_LO} <= 2 AND {_HI} < 10 THEN 1 ELSE 0 END END)"


@query(f"WITH {SEATS}, k AS (SELECT DISTINCT c1, c2, {_NAME} AS class, CAST({_CHEN} AS BIGINT) AS points, CAST(CASE WHEN c1 % 4 = c2 % 4 THEN (12 - {_HI}) * 13 + 12 - {_LO} ELSE (12 - {_LO}) * 13 + 12 - {_HI} END AS INTEGER) AS grid FROM (SELECT c1::INT AS c1, c2::INT AS c2 FROM s) WHERE c1 IS NOT NULL AND c2 IS NOT NULL) SELECT c1::TINYINT AS c1, c2::TINYINT AS c2, class, points, grid, CAST(coalesce(\"group\", 9) AS INTEGER) AS \"group\" FROM k LEFT JOIN (SELECT i AS \"group\", unnest(string_split(h, ' ')) AS class FROM (VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(cards.GROUPS, 1)) + ") v(i, h)) USING (class)")
def starting_hand_scores(spark: SparkSession, d: str) -> DataFrame:
    """Class, points by Chen's formula, place in the grid and published group of every two cards dealt."""
    k = seats(spark, d).filter("c1 is not null and c2 is not null").select("c1", "c2").distinct()
    c1, c2 = F.col("c1"), F.col("c2")
    return k.select("c1", "c2", cards.class_169(c1, c2).alias("class"), cards.chen(c1, c2).alias("points"), cards.grid_index(c1, c2).alias("grid"), cards.group_of(cards.class_169(c1, c2)).alias("group"))


@query()
def starting_hand_strength(spark: SparkSession, d: str) -> DataFrame:
    """Share of the pot of the 169 starting hands against one to five random ones, and the share of hands as strong."""
    by = {1: cards.against_random()} | {n: cards.against_random(n, 3_000) for n in range(2, 6)}
    top = cards.top_share(by[1])
    return spark.createDataFrame([(c, *(by[n][c] for n in by), top[c]) for c in by[1]], "class string, " + ", ".join(f"vs{n} double" for n in by) + ", top double")


@query()
def heads_up_win_tie(spark: SparkSession, d: str) -> DataFrame:
    """Exact chances of the two players at showdown, as the cards lay on the flop: winning, tying and losing."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def chances(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series, board: pd.Series) -> pd.Series:
        out = []
        for w, x, y, z, b in zip(a1, a2, b1, b2, board):
            known = [int(c) for c in b[:3]]
            ok = len({w, x, y, z, *known}) == 7
            out.append(list(cards.win_tie((w, x), (y, z), known)) if ok else None)
        return pd.Series(out)

    board = table(spark, d, "hands").filter("hand_idx is not null and size(board) >= 3").groupBy("hand_idx").agg(F.max("board").alias("board"))
    sd = seats(spark, d).filter("went_to_showdown and c1 is not null and c2 is not null").groupBy("hand_idx").agg(F.array_sort(F.collect_list(F.struct("player_idx", "c1", "c2"))).alias("h")).filter("size(h) = 2")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # fixed: the work is in the runs of the board
    rows = sd.join(board, "hand_idx").repartition(tasks, "hand_idx").withColumn("p", chances(*(F.col("h")[i][c].cast("int") for i in (0, 1) for c in ("c1", "c2")), "board")).filter("p is not null")
    return rows.select("hand_idx", F.expr("h[0].player_idx").alias("a"), F.expr("h[1].player_idx").alias("b"), F.expr("p[0]").alias("win"), F.expr("p[1]").alias("tie"))


# Members and detectors


@query(f"WITH {HANDS}, {SEATS} SELECT player_idx, min(table_idx) AS table_idx, count(DISTINCT table_idx) AS tables FROM s JOIN h USING (hand_idx) WHERE table_idx IS NOT NULL GROUP BY 1")
def player_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table of every player, the smallest, and at how many he sat."""
    s = seats(spark, d).select("hand_idx", "player_idx").join(hands(spark, d).filter("table_idx is not null").select("hand_idx", "table_idx"), "hand_idx")
    return s.groupBy("player_idx").agg(F.min("table_idx").alias("table_idx"), F.count_distinct("table_idx").alias("tables"))


#: Detectors of a hand and pair, over meetings(): X acts, Y is the partner. In SQL.
DETECTORS = {
    "fold_to_partner_raise": "isfold AND l = y AND tc > 0", "raise_vs_partner": "aggr AND l = y AND tc > 0", "call_partner": "calls AND l = y AND tc > 0", "overraise_third": "aggr AND tc > 0 AND ya AND l <> y AND l <> x AND nact >= 3",
}
OPEN_DETECTORS = {
    "fold_best_vs_partner": "isfold AND l = y AND tc > 0 AND eqx >= 0.5", "fold_strong_vs_partner": "isfold AND l = y AND tc > 0 AND ((street = 0 AND xtp <= 0.15) OR (street > 0 AND hs >= 0.8))",
    "call_dead_vs_partner": "street > 0 AND calls AND l = y AND tc > 0 AND eqx <= 0.15 AND eqy >= 0.7", "aggr_dead_into_partner": "street > 0 AND aggr AND ya AND eqx <= 0.15 AND eqy >= 0.7",
    "passive_strong_heads_up": "street > 0 AND ya AND nact = 2 AND eqx >= 0.8 AND (act = 1 OR calls)", "river_check_nuts": "street = 3 AND ya AND nact = 2 AND eqx >= 0.99 AND act = 1",
    "fold_playable_to_partner": "street = 0 AND isfold AND l = y AND tc > 0 AND xtp <= 0.35", "weak_raise_over_third": "aggr AND tc > 0 AND ya AND l <> y AND l <> x AND nact >= 3 AND ((street = 0 AND xtp >= 0.4) OR (street > 0 AND hs <= 0.5))",
}
_DET = lambda which: {k: f"CAST(sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS BIGINT)" for k, e in which.items()}
_HANDLY = {"third_folds": "max(CASE WHEN s THEN tf_act END)", "sandwich": "max(CASE WHEN s THEN CAST(sandwich AS INT) END)"}


def detectors(rows: DataFrame, which: dict) -> DataFrame:
    """(hand_idx, a, b, detectors): counts over both directions of a pair."""
    both = rows.groupBy("hand_idx", "x", "y").agg(*(F.expr(e).alias(k) for k, e in (_DET(which) | _HANDLY).items()))
    pair = both.groupBy("hand_idx", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pair.agg(*(F.sum(k).alias(k) for k in [*which, "third_folds"]), F.max("sandwich").alias("sandwich"))


@query(Q._XY + ", dt AS (SELECT hand_idx, x, y, " + ", ".join(f"{e} AS {k}" for k, e in (_DET(DETECTORS) | _HANDLY).items()) + " FROM xy GROUP BY 1, 2, 3) SELECT hand_idx, least(x, y) AS a, greatest(x, y) AS b, " + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in [*DETECTORS, "third_folds"]) + ", max(sandwich) AS sandwich FROM dt GROUP BY 1, 2, 3")
def domain_detectors(spark: SparkSession, d: str) -> DataFrame:
    """How often in a hand one of a pair folded, called or raised against the other, a third folded to one of them, or was caught between both."""
    return detectors(Q.met(spark, d), DETECTORS)


@query()
def open_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Detectors that need the cards: best hands folded, dead ones paid off, strong ones not bet, and what these cost."""
    cost = {
        "fold_best_cost": "sum(CASE WHEN isfold AND l = y AND tc > 0 AND eqx >= 0.5 THEN eqx * pot / bb ELSE 0 END)", "call_dead_cost": "sum(CASE WHEN street > 0 AND calls AND l = y AND tc > 0 AND eqx <= 0.15 AND eqy >= 0.7 THEN (1 - eqx) * amount / bb ELSE 0 END)",
        "aggr_dead_cost": "sum(CASE WHEN street > 0 AND aggr AND ya AND eqx <= 0.15 AND eqy >= 0.7 THEN eqy * amount / bb ELSE 0 END)",
        "passive_cost": "sum(CASE WHEN street > 0 AND ya AND nact = 2 AND eqx >= 0.8 AND (act = 1 OR calls) THEN eqx * pot / bb ELSE 0 END)",
    }
    rows = Q.met_open(spark, d)
    both = rows.groupBy("hand_idx", "x", "y").agg(*(F.expr(e).alias(k) for k, e in (_DET(OPEN_DETECTORS) | cost | {"imp": "sum(imp)"}).items()))
    pair = both.groupBy("hand_idx", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pair.agg(*(F.sum(k).alias(k) for k in [*OPEN_DETECTORS, *cost]), F.max("imp").alias("imp_max"), F.sum("imp").alias("imp_sum"))


# Scores, lists and measures

_RULES = {
    "sc_dt": "CASE WHEN (net_bb_ab < 0 AND net_bb_ba > 0) OR (net_bb_ba < 0 AND net_bb_ab > 0) THEN least(abs(net_bb_ab), abs(net_bb_ba)) + 5 * CASE WHEN CASE WHEN net_bb_ab < 0 THEN fold_pre_ab + fold_post_ab ELSE fold_pre_ba + fold_post_ba END > 0 THEN 1 ELSE 0 END ELSE -1 END",
    "sc_sp": "CASE WHEN enter_ab = 1 AND enter_ba = 1 THEN CASE WHEN fold_pre_ab + fold_post_ab + call_pre_ab + call_post_ab + fold_pre_ba + fold_post_ba + call_pre_ba + call_post_ba > 0 AND raise_pre_ab + raise_post_ab + raise_pre_ba + raise_post_ba = 0 THEN 10 ELSE 0 END + both_streets + CASE WHEN hu_checked_streets > 0 THEN 2 ELSE 0 END ELSE -1 END",
    "sc_ci": "CASE WHEN weak10_ab + weak10_ba > 0 THEN 10 ELSE 0 END + CASE WHEN fold_after_aggr_ab = 1 OR fold_after_aggr_ba = 1 OR raise_pre_ab + raise_pre_ba > 0 THEN 5 ELSE 0 END + tf_pre",
}


@query(Q._PH + " SELECT hand_idx, a, b, " + ", ".join(f"round(CAST({e} AS DOUBLE), 5) AS {k}" for k, e in _RULES.items()) + " FROM ph")
def table_rules(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a pair-hand by hand-written rules: transfer, soft play, isolation; -1 where the rule's gate is shut."""
    return Q.paired(spark, d).select("hand_idx", "a", "b", *(F.round(F.expr(f"CAST({e} AS DOUBLE)"), 5).alias(k) for k, e in _RULES.items()))


@query(_PAIRHAND + """, r AS (SELECT a, b, abs(transfer) AS v, row_number() OVER (PARTITION BY a, b ORDER BY abs(transfer) DESC, hand_idx) AS i FROM ph), t AS (SELECT a, b, avg(v) AS t5 FROM r WHERE i <= 5 GROUP BY 1, 2),
l AS (SELECT a AS m, a, b, t5 FROM t UNION ALL SELECT b, a, b, t5 FROM t), o AS (SELECT a, b, t5, (sum(t5) OVER (PARTITION BY m) - t5) / nullif(count(*) OVER (PARTITION BY m) - 1, 0) AS other FROM l) SELECT a, b, round(max(t5) - avg(other), 7) AS centred FROM o GROUP BY 1, 2""")
def centred_top5(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a pair's five greatest transfers less the mean of its members' other pairs."""
    v = pair_hands(spark, d).select("a", "b", "hand_idx", F.abs("transfer").alias("v"))
    t = ranking.top_k(v, ["a", "b"], [F.col("v").desc(), F.col("hand_idx")], 5).groupBy("a", "b").agg(F.avg("v").alias("t5"))
    long = t.withColumn("m", F.explode(F.array("a", "b"))).withColumn("other", B.other_mean(F.col("t5"), "m"))
    return long.groupBy("a", "b").agg(F.round(F.max("t5") - F.avg("other"), 7).alias("centred"))


_TAIL = [0.5, 0.8, 0.9, 0.95, 0.99, 0.999]
_LAB = "lab AS (SELECT p1 AS a, p2 AS b, max(label) AS label FROM labels WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)"


@query(_PAIRHAND + f", {_LAB}, v AS (SELECT ph.a, ph.b, hand_idx, abs(transfer) AS v, label FROM ph LEFT JOIN lab ON lab.a = ph.a AND lab.b = ph.b), q AS (SELECT quantile_cont(v, {_TAIL}) AS e FROM v WHERE label = 0), k AS (SELECT v.*, " + " + ".join(f"(v > e[{i + 1}])::INT" for i in range(len(_TAIL))) + f""" AS bin FROM v, q),
c AS (SELECT bin, sum((label = 1)::INT) AS p, sum((label = 0)::INT) AS n FROM k GROUP BY 1), t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM c), sl AS (SELECT k.a, k.b, k.hand_idx, ln(1 + 0.1 * (((coalesce(p, 0) + 1) / (tp + {len(_TAIL) + 1}.0)) / ((coalesce(n, 0) + 1) / (tn + {len(_TAIL) + 1}.0)) - 1)) AS llr FROM k JOIN c USING (bin), t),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY llr DESC, hand_idx) AS i FROM sl) SELECT a, b, round(sum(llr), 3) AS total, round(sum(llr) FILTER (i <= 5), 3) AS top5, round(max(llr), 5) AS most FROM r GROUP BY 1, 2""")
def mixture_llr(spark: SparkSession, d: str) -> DataFrame:
    """For every pair, the sum, the five greatest and the greatest of log1p(0.1 (LR - 1)) over all its hands; the bins of a hand's
    transfer end at quantiles of labelled negatives, out to their last thousandth."""
    lab = table(spark, d, "labels").filter("p1 is not null and p2 is not null and label is not null").groupBy(F.col("p1").alias("a"), F.col("p2").alias("b")).agg(F.max("label").alias("label"))
    v = pair_hands(spark, d).select("a", "b", "hand_idx", F.abs("transfer").alias("v")).join(lab, ["a", "b"], "left")
    edges = v.filter("label = 0").agg(F.percentile("v", _TAIL).alias("e"))
    k = v.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda x: F.col("v") > x)))  # one row
    counts = k.groupBy("bin").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    bins = len(_TAIL) + 1
    ratio = ((F.col("p") + 1) / (F.col("tp") + bins)) / ((F.col("n") + 1) / (F.col("tn") + bins))
    cell = counts.crossJoin(F.broadcast(counts.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn")))).select("bin", F.ln(1 + 0.1 * (ratio - 1)).alias("llr"))
    s = k.join(F.broadcast(cell), "bin").select("a", "b", "hand_idx", "llr")  # as many rows as bins
    i = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("llr").desc(), "hand_idx"))
    return s.withColumn("i", i).groupBy("a", "b").agg(F.round(F.sum("llr"), 3).alias("total"), F.round(F.sum(F.when(F.col("i") <= 5, F.col("llr"))), 3).alias("top5"), F.round(F.max("llr"), 5).alias("most"))


@query(_LABELLED + """, e AS (SELECT quantile_cont(score, 0.95) AS t FROM y WHERE NOT pos), r AS (SELECT avg((score > t)::INT) FILTER (pos) AS tpr, avg((score > t)::INT) FILTER (NOT pos) AS fpr FROM y, e), a AS (SELECT count(*) AS n, sum((round(flow::DOUBLE / n, 9) > t)::INT) AS k FROM (SELECT a, b, sum(flow) AS flow, sum(n) AS n FROM ps GROUP BY 1, 2), e)
SELECT n, CAST(k AS BIGINT) AS k, round(greatest(k::DOUBLE / n - fpr, 0) / nullif(tpr - fpr, 0), 6) AS share FROM a, r""")
def mixture_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of positives among all pairs, from how many exceed a bound that few negatives do: (k / n - fpr) / (tpr - fpr)."""
    y = labelled(spark, d, "left")
    t = y.filter("not pos").agg(F.percentile("score", 0.95).alias("t"))
    x = y.crossJoin(F.broadcast(t)).withColumn("over", (F.col("score") > F.col("t")).cast("int"))  # one row
    r = x.agg(F.count(F.lit(1)).alias("n"), F.sum("over").alias("k"), F.avg(F.when(F.col("pos"), F.col("over"))).alias("tpr"), F.avg(F.when(~F.col("pos"), F.col("over"))).alias("fpr"))
    return r.select("n", "k", R6(F.try_divide(F.greatest(F.col("k") / F.col("n") - F.col("fpr"), F.lit(0.0)), F.col("tpr") - F.col("fpr"))).alias("share"))


@query(Q.SEATED + """, k AS (SELECT player_idx AS x, street, least(nr, 2) AS nr, to_call > 0 AS facing, CASE WHEN aggr THEN 'aggr' WHEN calls THEN 'call' WHEN isfold THEN 'fold' ELSE 'check' END AS c FROM st WHERE to_call IS NOT NULL),
f AS (SELECT street, nr, facing, c, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY street, nr, facing) AS p, sum(count(*)) OVER (PARTITION BY street, nr, facing) AS n FROM k GROUP BY 1, 2, 3, 4), g AS (SELECT street, c, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY street) AS p FROM k GROUP BY 1, 2),
b AS (SELECT f.street, f.nr, f.facing, f.c, CASE WHEN f.n >= 150 THEN f.p ELSE g.p END AS p FROM f JOIN g ON g.street = f.street AND g.c = f.c), o AS (SELECT x, street, nr, facing, c, count(*) AS m, sum(count(*)) OVER (PARTITION BY x, street, nr, facing) AS n FROM k GROUP BY 1, 2, 3, 4, 5)
SELECT x AS player_idx, CAST(sum(m) AS BIGINT) AS n, round(sum(m * ln(((m + 10 * p) / (n + 10)) / p)), 4) AS llr FROM o JOIN b USING (street, nr, facing, c) GROUP BY 1""")
def context_llr(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood ratio of a player's choices by context (street, raises, facing a bet), smoothed to the population's rates of
    the context, which fall back to the street's where the context has fewer than 150 steps."""
    k = P.staged(P.by_hand(table(spark, d, "actions").filter(Q.is_step()), ["action_no"], P.STEP)).filter("to_call is not null")
    k = k.selectExpr("player_idx", "street", "least(nr, 2) as nr", "to_call > 0 as facing", "case when aggr then 'aggr' when calls then 'call' when isfold then 'fold' else 'check' end as c")
    ctx = ["street", "nr", "facing"]
    cells = k.groupBy("player_idx", *ctx, "c").agg(F.count(F.lit(1)).alias("m"))
    fine = cells.groupBy(*ctx, "c").agg(F.sum("m").alias("k"))
    n, s = F.sum("k").over(Window.partitionBy(*ctx)), F.sum("k").over(Window.partitionBy("street"))
    p = F.when(n >= 150, F.col("k") / n).otherwise(F.sum("k").over(Window.partitionBy("street", "c")) / s)
    own = F.sum("m").over(Window.partitionBy("player_idx", *ctx))
    rows = cells.withColumn("n", own).join(F.broadcast(fine.select(*ctx, "c", p.alias("p"))), [*ctx, "c"])  # at most 96 rows
    return rows.groupBy("player_idx").agg(F.sum("m").alias("n"), F.round(F.sum(F.col("m") * F.ln(((F.col("m") + 10 * F.col("p")) / (F.col("n") + 10)) / F.col("p"))), 4).alias("llr"))


_SUB = lambda name: "(" + {**D.ORACLES, **V.ORACLES}[name] + ")"


@query(f"SELECT round(0.7 * (SELECT ap FROM {_SUB('average_precision')}) + 0.2 * (SELECT map5 FROM {_SUB('map_at_5')}) + 0.1 * (SELECT avg(ap) FROM {_SUB('behaviour_ap')}), 5) AS composite")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """0.7 of the pairs' average precision, 0.2 of the lists' mean precision at five, 0.1 of the mean over families."""
    pair, lists = D.average_precision(spark, d).toDF("p"), D.map_at_5(spark, d).select(F.col("map5").alias("e"))
    family = D.behaviour_ap(spark, d).agg(F.avg("ap").alias("f"))
    return pair.crossJoin(lists).crossJoin(family).select(F.round(0.7 * F.col("p") + 0.2 * F.col("e") + 0.1 * F.col("f"), 5).alias("composite"))  # one row each


@query(f"""WITH {HANDS}, {SEATS}, l AS (SELECT pair_id, max(p1) AS p1, max(p2) AS p2 FROM labels WHERE pair_id IS NOT NULL GROUP BY 1), k AS (SELECT e.pair_id, e.hand_idx, count(*) AS n, min(evidence_rank) AS low FROM evidence e GROUP BY 1, 2),
c AS (SELECT k.*, l.pair_id IS NULL AS no_pair, h.hand_idx IS NULL AS no_hand, phase, x.hand_idx IS NOT NULL AND y.hand_idx IS NOT NULL AS seated FROM k LEFT JOIN l USING (pair_id) LEFT JOIN h ON h.hand_idx = k.hand_idx LEFT JOIN s x ON x.hand_idx = k.hand_idx AND x.player_idx = p1 LEFT JOIN s y ON y.hand_idx = k.hand_idx AND y.player_idx = p2)
SELECT count(*) AS listed, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (low < 1 OR low IS NULL) AS out_of_range, count(*) FILTER (no_pair) AS unknown_pair, count(*) FILTER (no_hand) AS unknown_hand, count(*) FILTER (phase = 1) AS second_phase, count(*) FILTER (NOT no_pair AND NOT no_hand AND NOT seated) AS not_both_seated FROM c""")
def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    """Listed hands that break a rule: listed twice, without a valid rank, of no known pair or hand, of the wrong phase, or in which
    the two did not both sit."""
    l = table(spark, d, "labels").filter("pair_id is not null").groupBy("pair_id").agg(F.max("p1").alias("p1"), F.max("p2").alias("p2")).withColumn("paired", F.lit(True))
    k = table(spark, d, "evidence").groupBy("pair_id", "hand_idx").agg(F.count(F.lit(1)).alias("n"), F.min("evidence_rank").alias("low"))
    h = hands(spark, d).select("hand_idx", "phase").withColumn("known", F.lit(True))
    s = seats(spark, d).select("hand_idx", "player_idx")
    at = lambda p: s.select("hand_idx", F.col("player_idx").alias(p), F.lit(True).alias(f"{p}_sat"))
    c = k.join(l, "pair_id", "left").join(h, "hand_idx", "left").join(at("p1"), ["hand_idx", "p1"], "left").join(at("p2"), ["hand_idx", "p2"], "left")
    no = lambda c: F.col(c).isNull()
    return c.agg(
        F.count(F.lit(1)).alias("listed"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if((F.col("low") < 1) | no("low")).alias("out_of_range"), F.count_if(no("paired")).alias("unknown_pair"),
        F.count_if(no("known")).alias("unknown_hand"), F.count_if(F.col("phase") == 1).alias("second_phase"), F.count_if(~no("paired") & ~no("known") & (no("p1_sat") | no("p2_sat"))).alias("not_both_seated"),
    )


@query(_LABELLED + f", r AS (SELECT a, b, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS r1, (rank() OVER (ORDER BY score2) + (count(*) OVER (PARTITION BY score2) - 1) / 2) / count(*) OVER () AS r2 FROM y) SELECT a, b, round(greatest(r1, r2), 6) AS most, round(r1 + r2, 6) AS total, round(0.5 * greatest(r1, r2) + 0.5 * (r1 + r2) / 2, 6) AS mixed FROM r")
def specialist_combiners(spark: SparkSession, d: str) -> DataFrame:
    """Two specialists' ranks put together by maximum, by sum, and by half of each."""
    r1, r2 = F.col("r1"), F.col("r2")
    return D.fused(spark, d).select("a", "b", R6(F.greatest(r1, r2)).alias("most"), R6(r1 + r2).alias("total"), R6(0.5 * F.greatest(r1, r2) + 0.5 * (r1 + r2) / 2).alias("mixed"))


@query(_PAIRHAND + _SC + f""", {HANDS.replace('h AS', 'hp AS')}, k AS (SELECT sc.*, row_number() OVER (PARTITION BY pair_id ORDER BY final_pot DESC NULLS LAST, hand_idx) AS pot_rank FROM sc LEFT JOIN hp USING (hand_idx)) SELECT pair_id, hand_idx, round(0.7 * s_a + 0.3 * s_b + 1e-7 / pot_rank, 9) AS blended FROM k""")
def blend_with_tie_break(spark: SparkSession, d: str) -> DataFrame:
    """A blend of two scores in which the greater pot goes first among equals."""
    pot = hands(spark, d).select("hand_idx", "final_pot")
    k = class_scores(spark, d).join(pot, "hand_idx", "left").withColumn("i", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col("final_pot").desc_nulls_last(), "hand_idx")))
    return k.select("pair_id", "hand_idx", F.round(0.7 * F.col("s_a") + 0.3 * F.col("s_b") + 1e-7 / F.col("i"), 9).alias("blended"))


# Model loops over labelled pairs


@query()
def own_fold_or_mean(spark: SparkSession, d: str) -> DataFrame:
    """A pair's score by the model of its own fold, which has not seen it, and the mean over the models of all folds."""
    rows = D.model_rows(spark, d).withColumn("label", F.coalesce("label", F.lit(0.0)))
    out = None
    for k in range(2):
        one = models.scored_by(rows.filter(F.col("fold") != k), rows, D.FEATURES, "label", "logistic", "w").select("a", "b", "fold", F.lit(k).alias("k"), F.get("probability", F.lit(1)).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("a", "b").agg(F.max(F.when(F.col("fold") == F.col("k"), F.col("p"))).alias("own"), F.avg("p").alias("mean"))


FAMILIES = ["directed_transfer", "soft_play", "coordinated_isolation"]


@query()
def family_specialists(spark: SparkSession, d: str) -> DataFrame:
    """For every family, a model of that family against the negatives, and one of all other families, each on held-out tables."""
    rows, out = D.model_rows(spark, d), None
    for f in FAMILIES:
        of = F.col("pos") & (F.col("family") == f)
        special = models.cross_fit(rows.withColumn("label", F.when(of, 1.0).when(~F.col("pos"), 0.0)), D.FEATURES, "fold", 2, "label", "logistic", "w").select("a", "b", F.get("probability", F.lit(1)).alias("special"))
        without = models.cross_fit(rows.withColumn("label", F.when(F.col("pos") & (F.col("family") != f), 1.0).when(~F.col("pos"), 0.0)), D.FEATURES, "fold", 2, "label", "logistic", "w").select("a", "b", F.get("probability", F.lit(1)).alias("without"))
        one = special.join(without, ["a", "b"]).withColumn("family", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def seed_bags(spark: SparkSession, d: str) -> DataFrame:
    """Three seeds of a forest put together: the mean probability, the mean logit, and that scaled again by Platt."""
    rows, p = D.model_rows(spark, d), None
    for seed in (1, 2, 3):
        one = models.cross_fit(rows, D.FEATURES, "fold", 2, "label", "forest", seeds=(seed,)).select("a", "b", "label", F.least(F.greatest(F.get("probability", F.lit(1)), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p"))
        p = one if p is None else p.unionByName(one)
    m = cut(p.groupBy("a", "b").agg(F.max("label").alias("label"), F.avg("p").alias("probmean"), F.avg(F.ln(F.col("p") / (1 - F.col("p")))).alias("margmean")))
    slope, intercept = models.platt(m, "margmean", "label")
    return m.select("a", "b", "probmean", "margmean", models.platt_scaled(F.col("margmean"), slope, intercept).alias("replatt"))


@query()
def pair_views(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs by three views of the features (counts, rates, both), and a family head whose classes weigh alike."""
    rows = D.model_rows(spark, d)
    views = {"counts": ["n", "flow", "sd"], "rates": ["score", "score2"], "both": D.FEATURES}
    out = rows.select("a", "b")
    for name, features in views.items():
        out = out.join(models.cross_fit(rows, features, "fold", 2, "label", "trees", "w").select("a", "b", F.get("probability", F.lit(1)).alias(name)), ["a", "b"])
    code = F.coalesce(*(F.when(F.col("pos") & (F.col("family") == f), F.lit(float(i + 1))) for i, f in enumerate(FAMILIES)), F.lit(0.0))
    coded = rows.withColumn("label", code)
    per = coded.groupBy("label").agg((F.lit(1.0) / F.count(F.lit(1))).alias("even"))
    head = models.cross_fit(coded.drop("w").join(F.broadcast(per), "label").withColumn("w", F.col("even") * 1000), D.FEATURES, "fold", 2, "label", "logistic", "w")  # as many rows as families
    return out.join(head.select("a", "b", F.col("probability").alias("families")), ["a", "b"])


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hands of positive labelled pairs with features of the pair-hand, whether they are listed, and the pair's fold."""
    lb = table(spark, d, "labels").filter("label = 1 and pair_id is not null and p1 is not null and p2 is not null").groupBy("pair_id").agg(F.max("p1").alias("a"), F.max("p2").alias("b"), F.max("behavior_family").alias("family"))
    near = listed(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("pair_id").orderBy("r", "hand_idx"))).select("pair_id", "hand_idx", "r")
    ph = pair_hands(spark, d).withColumns({"moved": F.abs("transfer"), "faced": F.col("face_ab") + F.col("face_ba"), "folded": F.col("fold_ab") + F.col("fold_ba"), "flop": F.col("both_flop").cast("int"), "sd": F.col("sd_both").cast("int")})
    rows = ph.join(lb, ["a", "b"]).join(near, ["pair_id", "hand_idx"], "left")
    last = F.max(F.when(F.col("r") <= 5, F.col("hand_idx"))).over(Window.partitionBy("pair_id"))
    rows = rows.withColumns({"label": F.when(F.col("r") <= 5, 1.0).otherwise(0.0), "last": last, "fold": F.pmod(F.xxhash64("pair_id"), F.lit(2)).cast("int")})
    return cut(rows.withColumns({f"is_{f}": (F.col("family") == f).cast("int") for f in FAMILIES}))


HAND_FEATURES = ["moved", "faced", "folded", "raiseback", "flop", "sd"]


@query()
def hand_rankers(spark: SparkSession, d: str) -> DataFrame:
    """Hands of positive pairs ranked by a model of all families, which sees the family, and by one per family."""
    rows = evidence_rows(spark, d)
    p = F.get("probability", F.lit(1))
    pooled = models.cross_fit(rows, [*HAND_FEATURES, *(f"is_{f}" for f in FAMILIES)], "fold", 2, "label").select("pair_id", "hand_idx", p.alias("pooled"))
    own = None
    for f in FAMILIES:
        one = models.cross_fit(rows.filter(F.col("family") == f), HAND_FEATURES, "fold", 2, "label").select("pair_id", "hand_idx", p.alias("own"))
        own = one if own is None else own.unionByName(one)
    return pooled.join(own, ["pair_id", "hand_idx"], "left")


@query()
def segment_model(spark: SparkSession, d: str) -> DataFrame:
    """Three classes of a positive pair's hands (listed, passed over, after the last listed one), and the fifteen likeliest ranked
    again by a model that sees how each compares with its list."""
    rows = evidence_rows(spark, d).withColumn("label", F.when(F.col("label") == 1, 2.0).when(F.col("hand_idx") < F.col("last"), 1.0).otherwise(0.0))
    first = cut(models.cross_fit(rows, HAND_FEATURES, "fold", 2, "label").withColumn("p", F.get("probability", F.lit(2))))
    short = ranking.top_k(first.drop("probability"), ["pair_id"], [F.col("p").desc(), F.col("hand_idx")], 15, "place").withColumn("label", (F.col("label") == 2).cast("double"))
    w = Window.partitionBy("pair_id")
    short = cut(short.withColumns({"share": F.col("p") / F.sum("p").over(w), "gap": F.max("p").over(w) - F.col("p")}))
    second = models.cross_fit(short, [*HAND_FEATURES, "p", "share", "gap", "place"], "fold", 2, "label").select("pair_id", "hand_idx", "place", F.get("probability", F.lit(1)).alias("again"))
    return first.select("pair_id", "hand_idx", "probability").join(second, ["pair_id", "hand_idx"], "left")


# Orientation, context and player models


_DONOR = """CASE WHEN net_bb_ab < 0 AND net_bb_ba > 0 THEN 'a' WHEN net_bb_ba < 0 AND net_bb_ab > 0 THEN 'b' WHEN gift_ab > gift_ba THEN 'a' WHEN gift_ab < gift_ba THEN 'b'
WHEN net_bb_ab < net_bb_ba THEN 'a' WHEN net_bb_ab > net_bb_ba THEN 'b' WHEN imp_ab >= imp_ba THEN 'a' ELSE 'b' END"""


@query()
def oriented_features(spark: SparkSession, d: str) -> DataFrame:
    """Who gives to whom in a pair-hand, by the flow of money, else by gifts, the result and the impact; and every directional
    feature as the greater and lesser of both and as the giver's and the taker's."""
    fields = {f.name: f for f in pairarrays.kinds(spark)}
    names = [c[:-3] for c in fields if c.endswith("_ab")]
    # Keys and directional features have no nulls; said so, they are written without levels.
    kinds = {c: fields[c].dataType for c in ("hand_idx", "a", "b")} | {"donor": StringType()} | {f"{c}_{n}": fields[f"{c}_ab"].dataType for c in names for n in _SIDES}
    schema = StructType([StructField(c, t, False) for c, t in kinds.items()])
    return Q.engine(spark, d, functools.partial(_oriented, names), schema)


_SIDES = {"max": "greatest({c}_ab, {c}_ba)", "min": "least({c}_ab, {c}_ba)", "donor": "CASE WHEN from_a THEN {c}_ab ELSE {c}_ba END", "receiver": "CASE WHEN from_a THEN {c}_ba ELSE {c}_ab END"}


def _oriented(names: list[str], rows: Frame) -> Frame:
    donor = rows.value(_DONOR.replace("'a'", "1").replace("'b'", "0"))[0] == 1
    rows.columns["from_a"] = donor, True
    keys = {c: rows.columns[c] for c in ("hand_idx", "a", "b")}
    return Frame(keys | {"donor": (np.where(donor, "a", "b"), True)} | {f"{c}_{n}": rows.value(e.format(c=c)) for c in names for n, e in _SIDES.items()}, rows.size)


METRICS = [
    "net_bb_ab", "net_bb_ba", "pot_bb", "face_ab", "face_ba", "fold_pre_ab", "fold_pre_ba", "fold_post_ab", "fold_post_ba", "call_post_ab", "call_post_ba", "raise_post_ab", "raise_post_ba", "minpa_ab", "minpa_ba", "aggpost_ab", "aggpost_ba",
    "tf_facing", "both_streets",
]


@query(Q._PH + " SELECT hand_idx, a, b, count(*) OVER (PARTITION BY a, b) AS shared, " + ", ".join(f"round((rank() OVER (PARTITION BY a, b ORDER BY round({m}, 6)) + (count(*) OVER (PARTITION BY a, b, round({m}, 6)) - 1) / 2) / count(*) OVER (PARTITION BY a, b), 6) AS {m}_place, rank() OVER (PARTITION BY a, b ORDER BY round({m}, 6) DESC) - 1 AS {m}_better" for m in METRICS) + " FROM ph")
def pair_metric_context(spark: SparkSession, d: str) -> DataFrame:
    """Where a hand stands among its pair's by 19 metrics: its place from below, equal values sharing the mean, and how many are
    greater."""
    w = Window.partitionBy("a", "b")
    rows = Q.paired(spark, d).select("hand_idx", "a", "b", *(F.round(m, 6).alias(m) for m in METRICS))
    n = F.count(F.lit(1)).over(w)
    place = lambda m: R6(ranking.average_rank(F.col(m), "a", "b") / n).alias(f"{m}_place")
    return rows.select("hand_idx", "a", "b", n.alias("shared"), *(c for m in METRICS for c in (place(m), (F.rank().over(w.orderBy(F.col(m).desc())) - 1).alias(f"{m}_better"))))


#: Contexts of a player's choices: which steps, and what counts as the choice.
CONTEXTS = {"fold_early": ("street = 0 and to_call > 0", "isfold"), "fold_late": ("street > 0 and to_call > 0", "isfold"), "bet": ("to_call = 0 and street > 0", "aggr")}


def choices(spark: SparkSession, d: str) -> DataFrame:
    """(hand_idx, player_idx, phase, context, chosen, street, k, offset): steps by context with the population's logit of the state."""
    k = P.staged(P.by_hand(table(spark, d, "actions").filter(Q.is_step()), ["action_no"], P.STEP)).join(hands(spark, d).select("hand_idx", "phase"), "hand_idx")
    found = F.array_compact(F.array(*(F.expr(f"case when {w} then named_struct('context', '{c}', 'chosen', cast({t} as int)) end") for c, (w, t) in CONTEXTS.items())))
    rows = k.select("hand_idx", "player_idx", "phase", "street", F.least("nr", F.lit(3)).cast("int").alias("k"), F.explode(found).alias("c")).select("*", "c.*").drop("c")
    p = rows.groupBy("context", "street", "k").agg(F.avg("chosen").alias("p"))
    logit = F.ln(F.greatest(F.col("p"), F.lit(1e-4)) / F.greatest(1 - F.col("p"), F.lit(1e-4)))
    return rows.join(F.broadcast(p.select("context", "street", "k", F.round(logit, 6).alias("offset"))), ["context", "street", "k"])  # at most 48 cells


@query()
def player_context_logits(spark: SparkSession, d: str) -> DataFrame:
    """A ridge logit for every player in each of three contexts, offset by the population's rate in the same state."""
    rows = choices(spark, d).withColumn("who", F.concat_ws("|", "player_idx", "context"))
    fits = models.entity_logits(rows, "who", "chosen", "offset", ["street", "k"])
    part = F.split("who", "[|]")
    return fits.select(part[0].cast("int").alias("player_idx"), part[1].alias("context"), "n", "beta")


@query()
def cross_phase_fit(spark: SparkSession, d: str) -> DataFrame:
    """Surprise of a player's choices in a hand under the logit that was fitted to his other phase: sum and greatest."""
    rows = choices(spark, d).filter("phase is not null").withColumn("who", F.concat_ws("|", "player_idx", "context", "phase"))
    fits = models.entity_logits(rows, "who", "chosen", "offset", ["street", "k"]).select("who", "beta")
    other = rows.withColumn("who", F.concat_ws("|", "player_idx", "context", (1 - F.col("phase")).cast("tinyint"))).join(fits, "who")
    b = lambda i: F.col("beta")[i]
    p = 1 / (1 + F.exp(-(b(0) + b(1) * F.col("street") + b(2) * F.col("k") + F.col("offset"))))
    p = F.least(F.greatest(F.when(F.col("chosen") == 1, p).otherwise(1 - p), F.lit(1e-6)), F.lit(1.0))
    return other.withColumn("s", -F.ln(p)).groupBy("hand_idx", "player_idx").agg(F.sum("s").alias("total"), F.max("s").alias("most"))
