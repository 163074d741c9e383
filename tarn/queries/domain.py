"""The hand log's own analyses: states, pairs against baselines, evidence lists, rankings and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators import baseline as B
from tarn.operators import cards, graph, listing, metrics, models, ordered, ranking, shaping
from tarn.operators.skew import with_group
from tarn.plans.lineage import cut
from tarn.queries.base import ACTIONS, HANDS, PAIRS, SEATS, actions, hands, pair_stats, seats
from tarn.queries.relational import R6, facing
from tarn.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_AGGR = "(action IN (3, 4) OR (action = 5 AND amount > to_call))"
_CALL = "(action = 2 OR (action = 5 AND amount <= to_call))"
AGGR = lambda: F.col("action").isin(3, 4) | ((F.col("action") == 5) & F.coalesce(F.col("amount") > F.col("to_call"), F.lit(False)))
CALL = lambda: (F.col("action") == 2) | ((F.col("action") == 5) & F.coalesce(F.col("amount") <= F.col("to_call"), F.lit(False)))
N = lambda c: F.count(F.when(c, 1))


# Ordered states


_STATE = f"""st AS (SELECT *, coalesce({_AGGR}, false) AS aggr, coalesce({_CALL}, false) AS calls,
CAST(coalesce(sum(coalesce({_AGGR}, false)::INT) OVER w, 0) AS BIGINT) AS nr, CAST(coalesce(sum(coalesce({_CALL}, false)::INT) OVER w, 0) AS BIGINT) AS nc
FROM a WINDOW w AS (PARTITION BY hand_idx, street ORDER BY action_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def states(spark: SparkSession, d: str) -> DataFrame:
    """Steps with their class and the raises and calls of the street before them."""
    a = actions(spark, d).withColumns({"aggr": AGGR(), "calls": CALL()})
    key = (["hand_idx", "street"], ["action_no"])
    return a.withColumns({"nr": ordered.prefix_sum(F.col("aggr").cast("bigint"), *key), "nc": ordered.prefix_sum(F.col("calls").cast("bigint"), *key)})


@query(f"""WITH {ACTIONS}, {_STATE} SELECT hand_idx, action_no, nr, nc, CAST(coalesce(sum(amount) OVER (PARTITION BY hand_idx, player_idx ORDER BY action_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS invested,
CAST(row_number() OVER (PARTITION BY hand_idx, player_idx ORDER BY action_no) - 1 AS INTEGER) AS own_steps, round(to_call::DOUBLE / nullif(pot_before + to_call, 0), 6) AS odds,
CAST(CASE WHEN to_call > 0 THEN 1 + 4 ELSE 2 END + CASE WHEN stack_before > to_call THEN 8 ELSE 0 END AS INTEGER) AS legal FROM st""")
def decision_states(spark: SparkSession, d: str) -> DataFrame:
    """The betting half of a decision: prefix counts, own investment, pot odds and the mask of legal classes."""
    own = (["hand_idx", "player_idx"], ["action_no"])
    pot = F.col("pot_before") + F.col("to_call")
    legal = F.when(F.col("to_call") > 0, 5).otherwise(2) + F.when(F.col("stack_before") > F.col("to_call"), 8).otherwise(0)
    return states(spark, d).select(
        "hand_idx", "action_no", "nr", "nc", ordered.prefix_sum(F.col("amount").cast("bigint"), *own).alias("invested"),
        (F.row_number().over(Window.partitionBy(*own[0]).orderBy(*own[1])) - 1).alias("own_steps"), R6(B.rate(F.col("to_call"), pot)).alias("odds"), legal.alias("legal"),
    )


@query(f"""WITH {ACTIONS}, n AS (SELECT *, lead(pot_before) OVER (PARTITION BY hand_idx ORDER BY action_no) AS next_pot, lead(action_no) OVER (PARTITION BY hand_idx ORDER BY action_no) AS next_no FROM a)
SELECT street, count(*) AS n, CAST(count(*) FILTER (next_no = action_no + 1 AND next_pot <> pot_before + amount) AS BIGINT) AS pot_breaks, CAST(count(*) FILTER (amount > stack_before) AS BIGINT) AS overdrawn, CAST(count(*) FILTER (next_no > action_no + 1) AS BIGINT) AS gaps FROM n GROUP BY 1""")
def log_checks(spark: SparkSession, d: str) -> DataFrame:
    """Steps that contradict the running pot or stack, and gaps in the numbering."""
    w = Window.partitionBy("hand_idx").orderBy("action_no")
    n = actions(spark, d).withColumns({"next_pot": F.lead("pot_before").over(w), "next_no": F.lead("action_no").over(w)})
    follows = F.col("next_no") == F.col("action_no") + 1
    return n.groupBy("street").agg(
        F.count(F.lit(1)).alias("n"), N(follows & (F.col("next_pot") != F.col("pot_before") + F.col("amount"))).alias("pot_breaks"),
        N(F.col("amount") > F.col("stack_before")).alias("overdrawn"), N(F.col("next_no") > F.col("action_no") + 1).alias("gaps"),
    )


@query(f"WITH {ACTIONS}, {_STATE} SELECT street, CAST(least(nr, 3) AS INTEGER) AS nr, CAST(least(nc, 2) AS INTEGER) AS nc, count(*) AS n, round(avg(aggr::INT), 6) AS p_aggr, round(avg(calls::INT), 6) AS p_call, round(avg((action = 0)::INT), 6) AS p_fold FROM st GROUP BY 1, 2, 3")
def population_rates(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: R6(F.avg(c.cast("int")))
    return states(spark, d).groupBy("street", F.least("nr", F.lit(3)).cast("int").alias("nr"), F.least("nc", F.lit(2)).cast("int").alias("nc")).agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("aggr")).alias("p_aggr"), mean(F.col("calls")).alias("p_call"), mean(F.col("action") == 0).alias("p_fold")
    )


@query(f"""WITH {ACTIONS}, {_STATE}, f AS (SELECT *, CAST(coalesce(sum((action = 0)::INT) OVER (PARTITION BY hand_idx ORDER BY action_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fb FROM st WHERE street = 0)
SELECT hand_idx, arg_min(fb, action_no) FILTER (aggr) AS folds_before, arg_min(player_idx, action_no) FILTER (aggr) AS opener FROM f GROUP BY 1""")
def folds_before_first_raise(spark: SparkSession, d: str) -> DataFrame:
    f = states(spark, d).filter("street = 0").withColumn("fb", ordered.prefix_sum((F.col("action") == 0).cast("bigint"), ["hand_idx"], ["action_no"]))
    first = lambda c: F.min_by(F.when(F.col("aggr"), F.col(c)), F.when(F.col("aggr"), F.col("action_no")))
    return f.groupBy("hand_idx").agg(first("fb").alias("folds_before"), first("player_idx").alias("opener"))


_CLOCKED = f"""WITH {HANDS}, {SEATS}, k AS (SELECT s.*, h.t, coalesce(net_chips, 0) AS net, bb FROM s JOIN h USING (hand_idx) WHERE h.t IS NOT NULL)"""


def clocked(spark: SparkSession, d: str) -> DataFrame:
    h = hands(spark, d).filter("t is not null").select("hand_idx", "t", "bb", "table_idx", "phase")
    return seats(spark, d).join(h, "hand_idx").withColumn("net", F.coalesce("net_chips", F.lit(0)))


@query(_CLOCKED + """, r AS (SELECT player_idx, sum(net) OVER (PARTITION BY player_idx ORDER BY t, hand_idx ROWS UNBOUNDED PRECEDING) AS run, t, hand_idx FROM k),
x AS (SELECT player_idx, greatest(0, max(run) OVER w) - run AS down, run - least(0, min(run) OVER w) AS up FROM r WINDOW w AS (PARTITION BY player_idx ORDER BY t, hand_idx ROWS UNBOUNDED PRECEDING))
SELECT player_idx, CAST(max(down) AS BIGINT) AS max_drawdown, CAST(max(up) AS BIGINT) AS max_runup FROM x GROUP BY 1""")
def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return ordered.drawdown(clocked(spark, d), ["player_idx"], ["t", "hand_idx"], "net")


@query(_CLOCKED + """, x AS (SELECT player_idx, net, coalesce(max((net <= -30 * bb)::INT) OVER (PARTITION BY player_idx ORDER BY t, hand_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) = 1 AS tilt FROM k)
SELECT player_idx, count(*) AS n, CAST(count(*) FILTER (tilt) AS BIGINT) AS tilted, CAST(coalesce(sum(net) FILTER (tilt), 0) AS BIGINT) AS tilted_net FROM x GROUP BY 1""")
def tilt_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hands within ten after a loss of 30 big blinds."""
    x = ordered.after_trigger(clocked(spark, d), ["player_idx"], ["t", "hand_idx"], F.col("net") <= -30 * F.col("bb"), 10, "tilt")
    return x.groupBy("player_idx").agg(F.count(F.lit(1)).alias("n"), N(F.col("tilt")).alias("tilted"), F.coalesce(F.sum(F.when(F.col("tilt"), F.col("net"))), F.lit(0)).alias("tilted_net"))


_COUNTERS = f"""WITH {HANDS}, {SEATS}, {ACTIONS}, {_STATE}, p AS (SELECT hand_idx, player_idx, bool_or(street = 0 AND (aggr OR calls)) AS vpip, bool_or(street = 0 AND aggr) AS pfr, bool_or(street = 0 AND nr = 1 AND aggr) AS three_bet,
bool_or(street = 0 AND nr = 1) AS three_bet_opp, bool_or(street > 0) AS saw, CAST(sum((street > 0 AND aggr)::INT) AS BIGINT) AS post_aggr, CAST(sum((street > 0 AND calls)::INT) AS BIGINT) AS post_calls FROM st GROUP BY 1, 2)"""


def hand_counters(spark: SparkSession, d: str) -> DataFrame:
    pre, aggr, calls = F.col("street") == 0, F.col("aggr"), F.col("calls")
    any_ = F.bool_or
    return states(spark, d).groupBy("hand_idx", "player_idx").agg(
        any_(pre & (aggr | calls)).alias("vpip"), any_(pre & aggr).alias("pfr"), any_(pre & (F.col("nr") == 1) & aggr).alias("three_bet"), any_(pre & (F.col("nr") == 1)).alias("three_bet_opp"),
        any_(~pre).alias("saw"), F.sum((~pre & aggr).cast("bigint")).alias("post_aggr"), F.sum((~pre & calls).cast("bigint")).alias("post_calls"),
    )


@query(_COUNTERS + """ SELECT s.player_idx, count(*) AS hands, round(avg(coalesce(vpip, false)::INT), 6) AS vpip, round(avg(coalesce(pfr, false)::INT), 6) AS pfr, round(sum(coalesce(three_bet, false)::INT)::DOUBLE / nullif(sum(coalesce(three_bet_opp, false)::INT), 0), 6) AS three_bet,
round(avg(coalesce(saw, false)::INT), 6) AS saw_flop, round((sum(coalesce(three_bet, false)::INT) + 1.0) / (sum(coalesce(three_bet_opp, false)::INT) + 10), 6) AS shrunk, round(sum(post_aggr)::DOUBLE / nullif(sum(post_calls), 0), 6) AS af, round(avg(coalesce(went_to_showdown, false)::INT), 6) AS sd FROM s LEFT JOIN p USING (hand_idx, player_idx) GROUP BY 1""")
def player_counters(spark: SparkSession, d: str) -> DataFrame:
    """Classic rates of every player; a ratio without opportunities is null, `shrunk` is drawn to 1 in 10."""
    j = seats(spark, d).join(hand_counters(spark, d), ["hand_idx", "player_idx"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    three, opp = F.sum(flag(F.col("three_bet"))), F.sum(flag(F.col("three_bet_opp")))
    mean = lambda c: R6(F.avg(flag(F.col(c))))
    return j.groupBy("player_idx").agg(
        F.count(F.lit(1)).alias("hands"), mean("vpip").alias("vpip"), mean("pfr").alias("pfr"), R6(B.rate(three, opp)).alias("three_bet"), mean("saw").alias("saw_flop"),
        R6((three + 1.0) / (opp + 10)).alias("shrunk"), R6(B.rate(F.sum("post_aggr"), F.sum("post_calls"))).alias("af"), mean("went_to_showdown").alias("sd"),
    )


_PAIRHAND = _COUNTERS + f""", fc AS (SELECT *, last_value(CASE WHEN aggr THEN player_idx END IGNORE NULLS) OVER (PARTITION BY hand_idx, street ORDER BY action_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ag FROM st),
resp AS (SELECT hand_idx, player_idx AS x, ag AS y, count(*) AS face, CAST(sum((action = 0)::INT) AS BIGINT) AS fold, CAST(sum(aggr::INT) AS BIGINT) AS back FROM fc WHERE ag IS NOT NULL AND ag <> player_idx AND to_call > 0 GROUP BY 1, 2, 3),
m AS (SELECT s.hand_idx, s.player_idx, coalesce(vpip, false) AS vpip, coalesce(saw, false) AS saw, coalesce(went_to_showdown, false) AS sd, coalesce(net_chips, 0) AS net, h.bb, final_pot FROM s JOIN h USING (hand_idx) LEFT JOIN p USING (hand_idx, player_idx)),
ph AS (SELECT a.hand_idx, a.player_idx AS a, b.player_idx AS b, a.vpip AND b.vpip AS both_vol, a.saw AND b.saw AS both_flop, a.sd AND b.sd AS sd_both, coalesce(r.face, 0) AS face_ab, coalesce(q.face, 0) AS face_ba, coalesce(r.fold, 0) AS fold_ab,
coalesce(q.fold, 0) AS fold_ba, coalesce(r.back, 0) + coalesce(q.back, 0) AS raiseback, round(a.net::DOUBLE / nullif(a.bb, 0), 4) AS net_ab, round(b.net::DOUBLE / nullif(a.bb, 0), 4) AS net_ba,
round(CASE WHEN a.net < 0 AND b.net > 0 THEN least(-a.net, b.net) WHEN b.net < 0 AND a.net > 0 THEN -least(-b.net, a.net) ELSE 0 END::DOUBLE / nullif(a.bb, 0), 4) AS transfer
FROM m a JOIN m b ON a.hand_idx = b.hand_idx AND a.player_idx < b.player_idx LEFT JOIN resp r ON r.hand_idx = a.hand_idx AND r.x = a.player_idx AND r.y = b.player_idx LEFT JOIN resp q ON q.hand_idx = a.hand_idx AND q.x = b.player_idx AND q.y = a.player_idx)"""


def pair_hands(spark: SparkSession, d: str) -> DataFrame:
    """One row per hand and pair of its players: joint states, responses to each other's aggression, and money moved."""
    r = (
        facing(spark, d).withColumn("aggr", AGGR()).filter("aggressor is not null and aggressor <> player_idx and to_call > 0")
        .groupBy("hand_idx", F.col("player_idx").alias("x"), F.col("aggressor").alias("y"))
        .agg(F.count(F.lit(1)).alias("face"), F.sum((F.col("action") == 0).cast("bigint")).alias("fold"), F.sum(F.col("aggr").cast("bigint")).alias("back"))
    )
    false = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    m = seats(spark, d).join(hands(spark, d).select("hand_idx", "bb"), "hand_idx").join(hand_counters(spark, d), ["hand_idx", "player_idx"], "left")
    m = m.select("hand_idx", "player_idx", "bb", false("vpip"), false("saw"), false("went_to_showdown"), F.coalesce("net_chips", F.lit(0)).alias("net"))
    a, b = m.select("hand_idx", *(F.col(c).alias(f"a_{c}") for c in m.columns[1:])), m.select("hand_idx", *(F.col(c).alias(f"b_{c}") for c in m.columns[1:]))
    pairs = a.join(b, "hand_idx").filter("a_player_idx < b_player_idx").withColumnsRenamed({"a_player_idx": "a", "b_player_idx": "b"})
    for side, (x, y) in {"ab": ("a", "b"), "ba": ("b", "a")}.items():
        pairs = pairs.join(r.select("hand_idx", F.col("x").alias(x), F.col("y").alias(y), *(F.col(c).alias(f"{c}_{side}") for c in ("face", "fold", "back"))), ["hand_idx", x, y], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    in_bb = lambda v: F.round(B.rate(v, F.col("a_bb")), 4)
    x, y = F.col("a_net"), F.col("b_net")
    moved = F.when((x < 0) & (y > 0), F.least(-x, y)).when((y < 0) & (x > 0), -F.least(-y, x)).otherwise(0)
    both = lambda c: F.col(f"a_{c}") & F.col(f"b_{c}")
    return pairs.select(
        "hand_idx", "a", "b", both("vpip").alias("both_vol"), both("saw").alias("both_flop"), both("went_to_showdown").alias("sd_both"), zero("face_ab").alias("face_ab"), zero("face_ba").alias("face_ba"),
        zero("fold_ab").alias("fold_ab"), zero("fold_ba").alias("fold_ba"), (zero("back_ab") + zero("back_ba")).alias("raiseback"), in_bb(x).alias("net_ab"), in_bb(y).alias("net_ba"), in_bb(moved).alias("transfer"),
    )



@query(_PAIRHAND + " SELECT * FROM ph")
def pair_hand_rows(spark: SparkSession, d: str) -> DataFrame:
    return pair_hands(spark, d)


FLAGS = ["both_vol", "both_flop", "sd_both", "soft", "flow"]
_FLAGGED = _PAIRHAND + ", fl AS (SELECT *, face_ab + face_ba > 0 AND raiseback = 0 AS soft, transfer <> 0 AS flow FROM ph)"


@query(_FLAGGED + ", g AS (SELECT " + ", ".join(f"avg({f}::INT) AS p_{f}" for f in FLAGS) + " FROM fl) SELECT a, b, count(*) AS n, " + ", ".join(f"round((sum({f}::INT) - count(*) * max(p_{f})) / sqrt(count(*) * max(p_{f}) * (1 - max(p_{f})) + 1e-9), 4) AS z_{f}" for f in FLAGS) + " FROM fl, g GROUP BY 1, 2 HAVING count(*) >= 12")
def pair_flag_z(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a pair's flags against the population rate, as binomial z, for pairs of 12 hands or more."""
    fl = pair_hands(spark, d).withColumns({"soft": (F.col("face_ab") + F.col("face_ba") > 0) & (F.col("raiseback") == 0), "flow": F.coalesce(F.col("transfer") != 0, F.lit(False))})
    counts = fl.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f).cast("bigint")).alias(f) for f in FLAGS))
    base = counts.agg(*((F.sum(f) / F.sum("n")).alias(f"p_{f}") for f in FLAGS))
    z = lambda f: F.round(B.binomial_z(F.col(f), F.col("n"), F.col(f"p_{f}")), 4).alias(f"z_{f}")
    return counts.filter("n >= 12").crossJoin(F.broadcast(base)).select("a", "b", "n", *(z(f) for f in FLAGS))  # one row


# Baselines


_DIRECTED = f"WITH {PAIRS}, d AS (SELECT table_idx, a AS x, b AS y, flow AS hit, n FROM ps UNION ALL SELECT p.table_idx, p.b, p.a, r.flow, p.n FROM ps p JOIN (SELECT x.table_idx, y.player_idx AS a, x.player_idx AS b, CAST(sum((x.net < 0 AND y.net > 0)::INT) AS BIGINT) AS flow FROM sat x JOIN sat y ON x.hand_idx = y.hand_idx AND x.player_idx > y.player_idx GROUP BY 1, 2, 3) r ON r.table_idx = p.table_idx AND r.a = p.a AND r.b = p.b)"


def directed(spark: SparkSession, d: str, tables: bool = True) -> DataFrame:
    """(table_idx, x, y, hit, n): hands shared at a table and those in which x lost and y won, both ways; or (x, y, hit, n) over all tables."""
    s = seats(spark, d).join(hands(spark, d).filter("table_idx is not null").select("hand_idx", "table_idx"), "hand_idx")
    s = s.select("hand_idx", "table_idx", "player_idx", F.coalesce("net_chips", F.lit(0)).alias("net"))
    x, y = s.alias("x"), s.alias("y")
    both = x.join(y, (F.col("x.hand_idx") == F.col("y.hand_idx")) & (F.col("x.player_idx") != F.col("y.player_idx")))
    hit = F.sum(((F.col("x.net") < 0) & (F.col("y.net") > 0)).cast("bigint")).alias("hit")
    table_key = [F.col("x.table_idx").alias("table_idx")] if tables else []
    return both.groupBy(*table_key, F.col("x.player_idx").alias("x"), F.col("y.player_idx").alias("y")).agg(hit, F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRS} SELECT * FROM ps")
def pair_totals(spark: SparkSession, d: str) -> DataFrame:
    return pair_stats(spark, d)


_OWN = _DIRECTED + """, t AS (SELECT x, y, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1, 2), e AS (SELECT *, n * coalesce((sum(hit) OVER w - hit)::DOUBLE / nullif(sum(n) OVER w - n, 0), 0) AS expected FROM t WINDOW w AS (PARTITION BY x)),
o AS (SELECT *, hit - expected AS excess, ln((hit + 1) / (expected + 1)) AS llift FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(llift, 9) DESC, y) AS rk FROM o)"""


@query(_OWN + " SELECT least(x, y) AS a, greatest(x, y) AS b, round(sum(excess), 6) AS exc_sum, round(min(llift), 6) AS llift_min, round(max(llift), 6) AS llift_max, bool_and(rk = 1) AS mutual_top, bool_or(rk = 1) AS top_any, CAST(max(rk) AS INTEGER) AS rank_worst FROM r GROUP BY 1, 2")
def own_baseline(spark: SparkSession, d: str) -> DataFrame:
    """How much more a player loses to this partner than to the others, folded to pairs."""
    t = directed(spark, d).groupBy("x", "y").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    p = B.unordered(B.own_baseline(t, "hit", "n"))
    return p.select("a", "b", R6("exc_sum").alias("exc_sum"), R6("llift_min").alias("llift_min"), R6("llift_max").alias("llift_max"), "mutual_top", "top_any", "rank_worst")


@query(_DIRECTED + """, t AS (SELECT x, y, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1, 2), e AS (SELECT *, least(greatest((sum(hit) OVER w - hit)::DOUBLE / greatest(sum(n) OVER w - n, 1), 1e-6), 1 - 1e-6) AS p FROM t WINDOW w AS (PARTITION BY x)),
z AS (SELECT x, y, (hit - n * p) / sqrt(n * p * (1 - p)) AS z FROM e), m AS (SELECT *, max(z) OVER (PARTITION BY x) AS top, row_number() OVER (PARTITION BY x ORDER BY z DESC, y) AS rz FROM z), sg AS (SELECT *, max(CASE WHEN rz = 2 THEN z END) OVER (PARTITION BY x) AS second FROM m)
SELECT x, y, round(exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY x), 5) AS share, round(z - CASE WHEN rz = 1 THEN second ELSE top END, 4) AS gap FROM sg""")
def softmax_gap(spark: SparkSession, d: str) -> DataFrame:
    """The z of a partner against his rivals for the same player: every player and every co-player."""
    z = B.leave_one_out_z(directed(spark, d, tables=False), "hit", "n")
    return B.softmax_gap(z, "x", "z", "y").select("x", "y", F.round("share", 5).alias("share"), F.round("gap", 4).alias("gap"))


_ROWCOL = _DIRECTED + """, e AS (SELECT *, sum(hit) OVER (PARTITION BY table_idx)::DOUBLE / sum(n) OVER (PARTITION BY table_idx) AS p FROM d),
f AS (SELECT *, (sum(hit) OVER (PARTITION BY table_idx, x) - hit + 20 * p) / (sum(n) OVER (PARTITION BY table_idx, x) - n + 20) AS px, (sum(hit) OVER (PARTITION BY table_idx, y) - hit + 20 * p) / (sum(n) OVER (PARTITION BY table_idx, y) - n + 20) AS py FROM e),
g AS (SELECT table_idx, x, y, hit, n, CASE WHEN p > 0 THEN n * least(px * py / p, 1) ELSE 0 END AS expected FROM f),
gg AS (SELECT *, CASE WHEN expected <= 0 THEN 0 ELSE sign(hit - expected) * 2 * (CASE WHEN hit > 0 THEN hit * ln(hit / expected) ELSE 0 END - (hit - expected)) END AS g FROM g)"""


def rowcol(spark: SparkSession, d: str) -> DataFrame:
    return B.row_column_expectation(directed(spark, d), "table_idx", "hit", "n")


@query(_ROWCOL + " SELECT table_idx, x, y, round(expected, 5) AS expected, round(g, 4) AS g FROM gg")
def row_column_g(spark: SparkSession, d: str) -> DataFrame:
    """Hits against those expected if givers and takers were independent, as a signed deviance."""
    return rowcol(spark, d).select("table_idx", "x", "y", F.round("expected", 5).alias("expected"), F.round("g", 4).alias("g"))


@query(_ROWCOL + """, r AS (SELECT *, row_number() OVER (PARTITION BY table_idx, x ORDER BY round(g, 6) DESC, y) = 1 AS row_top, row_number() OVER (PARTITION BY table_idx, y ORDER BY round(g, 6) DESC, x) = 1 AS col_top FROM gg)
SELECT table_idx, least(x, y) AS a, greatest(x, y) AS b, round(sum(greatest(g, 0)), 4) AS g_pos, round(sum(CASE WHEN row_top THEN greatest(g, 0) ELSE 0 END), 4) AS g_top, round(max(g), 4) AS g_max, round(least(min(g), max(g)), 4) AS g_sym, bool_or(row_top AND col_top) AS mutual FROM r GROUP BY 1, 2, 3""")
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    """A pair's deviances over both directions, with flags of rows' and columns' tops."""
    top = lambda k, t: F.row_number().over(Window.partitionBy("table_idx", k).orderBy(F.round("g", 6).desc(), t)) == 1
    r = rowcol(spark, d).withColumns({"row_top": top("x", "y"), "col_top": top("y", "x")})
    pos = F.greatest(F.col("g"), F.lit(0.0))
    return r.groupBy("table_idx", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.round(F.sum(pos), 4).alias("g_pos"), F.round(F.sum(F.when(F.col("row_top"), pos).otherwise(0.0)), 4).alias("g_top"), F.round(F.max("g"), 4).alias("g_max"),
        F.round(F.least(F.min("g"), F.max("g")), 4).alias("g_sym"), F.bool_or(F.col("row_top") & F.col("col_top")).alias("mutual"),
    )


@query(f"WITH {PAIRS}, w AS (SELECT a, b, sum(flow) AS f, sum(n) AS n FROM ps GROUP BY 1, 2), p AS (SELECT a, sum(f) AS tf, sum(n) AS tn FROM w GROUP BY 1) SELECT w.a, w.b, round(ln(((f + 1.0) / (n + 10.0)) / ((tf - f + 1.0) / (tn - n + 10.0))), 6) AS lift FROM w JOIN p ON w.a = p.a")
def with_without_lift(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed log ratio of the rate with the partner and without."""
    w = pair_stats(spark, d).groupBy("a", "b").agg(F.sum("flow").alias("f"), F.sum("n").alias("n"))
    w = with_group(w, ["a"], ["b"], tf=F.sum("f"), tn=F.sum("n"))
    r = ((F.col("f") + 1.0) / (F.col("n") + 10.0)) / ((F.col("tf") - F.col("f") + 1.0) / (F.col("tn") - F.col("n") + 10.0))
    return w.select("a", "b", R6(F.ln(r)).alias("lift"))


@query(f"WITH {PAIRS}, r AS (SELECT table_idx, a, b, flow::DOUBLE / n AS r FROM ps WHERE n >= 3) SELECT table_idx, a, b, round((r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0), 5) AS z FROM r WINDOW w AS (PARTITION BY table_idx)")
def within_table_z(spark: SparkSession, d: str) -> DataFrame:
    r = pair_stats(spark, d).filter("n >= 3").withColumn("r", F.col("flow") / F.col("n"))
    return r.select("table_idx", "a", "b", F.round(B.group_z(F.col("r"), "table_idx"), 5).alias("z"))


@query(f"WITH {PAIRS}, r AS (SELECT a, b, sum(flow)::DOUBLE / sum(n) AS r FROM ps GROUP BY 1, 2), l AS (SELECT a AS m, a, b, r FROM r UNION ALL SELECT b, a, b, r FROM r), o AS (SELECT m, a, b, r, (sum(r) OVER w - r) / nullif(count(*) OVER w - 1, 0) AS other FROM l WINDOW w AS (PARTITION BY m)) SELECT a, b, round(max(r) - avg(other), 6) AS centred FROM o GROUP BY 1, 2")
def double_centred(spark: SparkSession, d: str) -> DataFrame:
    """A pair's rate less the mean of its members' other pairs."""
    r = pair_stats(spark, d).groupBy("a", "b").agg((F.sum("flow") / F.sum("n")).alias("r"))
    long = r.withColumn("m", F.explode(F.array("a", "b"))).withColumn("other", B.other_mean(F.col("r"), "m"))
    return long.groupBy("a", "b").agg(R6(F.max("r") - F.avg("other")).alias("centred"))


_LABELLED = f"WITH {PAIRS}, lab AS (SELECT p1 AS a, p2 AS b, max(label) AS label, max(behavior_family) AS family FROM labels WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2), x AS (SELECT a, b, sum(n) AS n, sum(flow) AS flow, sum(\"both\") AS sd, round(sum(flow)::DOUBLE / sum(n), 9) AS score, round(sum(\"both\")::DOUBLE / sum(n), 9) AS score2 FROM ps GROUP BY 1, 2), y AS (SELECT x.*, label = 1 AS pos, family FROM x JOIN lab USING (a, b))"


def labelled(spark: SparkSession, d: str, how: str = "inner") -> DataFrame:
    """(a, b, n, flow, sd, score, score2, pos, family): labelled pairs with simple scores; with how = "left" all pairs, pos being null
    where there is no label."""
    lab = table(spark, d, "labels").filter("p1 is not null and p2 is not null and label is not null")
    lab = lab.groupBy(F.col("p1").alias("a"), F.col("p2").alias("b")).agg(F.max("label").alias("label"), F.max("behavior_family").alias("family"))
    x = pair_stats(spark, d).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("flow").alias("flow"), F.sum("both").alias("sd"))
    x = x.withColumns({"score": F.round(F.col("flow") / F.col("n"), 9), "score2": F.round(F.col("sd") / F.col("n"), 9)})
    return x.join(lab, ["a", "b"], how).withColumn("pos", F.col("label") == 1).drop("label")


KEY = lambda: F.col("a").cast("bigint") * 4294967296 + F.col("b")
_KEY = "a::BIGINT * 4294967296 + b"


@query(_LABELLED + ", q AS (SELECT max(score) AS m1, max(score2) AS m2 FROM y WHERE NOT pos) SELECT a, b, score > m1 AS over1, score2 > m2 AS over2 FROM y, q")
def above_all_negatives(spark: SparkSession, d: str) -> DataFrame:
    y = labelled(spark, d)
    q = y.filter(~F.col("pos")).agg(F.max("score").alias("m1"), F.max("score2").alias("m2"))
    return y.crossJoin(F.broadcast(q)).select("a", "b", (F.col("score") > F.col("m1")).alias("over1"), (F.col("score2") > F.col("m2")).alias("over2"))  # one row


EDGES = [0.1, 0.15, 0.2, 0.25]
_BIN = " + ".join(f"(score > {e})::INT" for e in EDGES)


@query(_LABELLED + f", k AS (SELECT *, {_BIN} AS bin FROM y), c AS (SELECT bin, sum(pos::INT) AS p, sum((NOT pos)::INT) AS q FROM k GROUP BY 1), t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM c) SELECT a, b, CAST(bin AS INTEGER) AS bin, round(ln(1 + 0.1 * (((p + 1) / (tp + 5.0)) / ((q + 1) / (tq + 5.0)) - 1)), 6) AS llr FROM k JOIN c USING (bin), t")
def histogram_llr(spark: SparkSession, d: str) -> DataFrame:
    y = B.histogram_llr(labelled(spark, d), "score", "pos", EDGES, 0.1)
    return y.select("a", "b", F.col("bin").cast("int").alias("bin"), R6("llr").alias("llr"))


@query(_LABELLED + ", c AS (SELECT family, count(*) AS m, sum((score > 0.2)::INT) AS k FROM y GROUP BY 1), p AS (SELECT family, m, k, k::DOUBLE / m AS p FROM c) SELECT family, m AS n, round((p + 3.8416 / (2 * m) - 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4.0 * m * m))) / (1 + 3.8416 / m), 6) AS low, round((p + 3.8416 / (2 * m) + 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4.0 * m * m))) / (1 + 3.8416 / m), 6) AS high FROM p")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    c = labelled(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") > 0.2).cast("bigint")).alias("k"))
    low, high = B.wilson(F.col("k"), F.col("n"))
    return c.select("family", "n", R6(low).alias("low"), R6(high).alias("high"))


@query(f"WITH {HANDS}, {SEATS}, k AS (SELECT least(x.player_idx, y.player_idx) AS a, greatest(x.player_idx, y.player_idx) AS b, phase, bool_or(x.net_chips < -2000 AND y.net_chips > 2000) AS hit FROM s x JOIN s y ON x.hand_idx = y.hand_idx AND x.player_idx <> y.player_idx JOIN h ON h.hand_idx = x.hand_idx WHERE phase IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT a, b, coalesce(bool_or(hit) FILTER (phase = 0), false) AS h0, coalesce(bool_or(hit) FILTER (phase = 1), false) AS h1 FROM k GROUP BY 1, 2) SELECT CAST(sum((h0 AND NOT h1)::INT) AS BIGINT) AS only0, CAST(sum((h1 AND NOT h0)::INT) AS BIGINT) AS only1, round((sum((h0 AND NOT h1)::INT) - sum((h1 AND NOT h0)::INT)) / sqrt(sum((h0 <> h1)::INT)), 6) AS z FROM w")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a large flow in one phase only."""
    s = seats(spark, d).select("hand_idx", "player_idx", "net_chips").join(hands(spark, d).filter("phase is not null").select("hand_idx", "phase"), "hand_idx")
    x, y = s.alias("x"), s.select("hand_idx", F.col("player_idx").alias("q"), F.col("net_chips").alias("won"))
    both = x.join(y, "hand_idx").filter("player_idx <> q")
    hit = lambda p: F.coalesce(F.bool_or(F.when(F.col("phase") == p, (F.col("net_chips") < -2000) & (F.col("won") > 2000))), F.lit(False))
    w = both.groupBy(F.least("player_idx", "q").alias("a"), F.greatest("player_idx", "q").alias("b")).agg(hit(0).alias("h0"), hit(1).alias("h1"))
    one, two = F.sum((F.col("h0") & ~F.col("h1")).cast("bigint")), F.sum((F.col("h1") & ~F.col("h0")).cast("bigint"))
    return w.agg(one.alias("only0"), two.alias("only1"), R6((one - two) / F.sqrt(one + two)).alias("z"))


@query(f"WITH {ACTIONS}, g AS (SELECT player_idx, street, count(*) AS n, sum((action = 0)::INT) AS k FROM a GROUP BY 1, 2), p AS (SELECT street, sum(k)::DOUBLE / sum(n) AS p FROM g GROUP BY 1) SELECT player_idx, g.street, round(k * ln(((k + 10 * p) / (n + 10)) / p) + (n - k) * ln((1 - (k + 10 * p) / (n + 10)) / (1 - p)), 4) AS llr FROM g JOIN p ON g.street = p.street")
def action_llr(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood ratio of a player's smoothed fold rate against the street's."""
    g = actions(spark, d).groupBy("player_idx", "street").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("action") == 0).cast("bigint")).alias("k"))
    p = g.groupBy("street").agg((F.sum("k") / F.sum("n")).alias("p"))
    k, n, q = F.col("k"), F.col("n"), F.col("p")
    own = (k + 10 * q) / (n + 10)
    return g.join(F.broadcast(p), "street").select("player_idx", "street", F.round(k * F.ln(own / q) + (n - k) * F.ln((1 - own) / (1 - q)), 4).alias("llr"))  # four streets


@query()
def poisson_null(spark: SparkSession, d: str) -> DataFrame:
    """Hits redrawn under independence, one number a pair, seeded by the pair: each null has the deviances of its own draw."""
    r = rowcol(spark, d)
    u = shaping.uniform("table_idx", "x", "y", seed="null")
    drawn = B.poisson_quantile(u, F.col("expected"))
    return r.select("table_idx", "x", "y", drawn.alias("null_hit"), F.round(B.signed_poisson(drawn, F.col("expected")), 4).alias("null_g"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p1, p2 FROM labels WHERE label = 1 AND p1 IS NOT NULL AND p2 IS NOT NULL), b AS (SELECT p1 AS u, p2 AS v FROM e UNION SELECT p2, p1 FROM e),
r AS (SELECT u, u AS v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u) SELECT u AS player_idx, min(v) AS component FROM r GROUP BY 1""")
def positive_components(spark: SparkSession, d: str) -> DataFrame:
    """Players tied by positive labels, over any number of steps."""
    e = table(spark, d, "labels").filter("label = 1 and p1 is not null and p2 is not null").select("p1", "p2").distinct()
    links = e.select(F.explode(F.array("p1", "p2")).alias("player_idx"), F.struct("p1", "p2").alias("edge"))
    return graph.connected_components(links, "player_idx", "edge")


# Cards


@query(f"WITH {SEATS} SELECT hand_idx, player_idx, CAST(CASE WHEN c1 // 4 = c2 // 4 THEN 0 WHEN c1 % 4 = c2 % 4 THEN 1 ELSE 2 END AS INTEGER) AS kind, substr('23456789TJQKA', CAST(greatest(c1 // 4, c2 // 4) AS INTEGER) + 1, 1) || substr('23456789TJQKA', CAST(least(c1 // 4, c2 // 4) AS INTEGER) + 1, 1) || CASE WHEN c1 // 4 = c2 // 4 THEN '' WHEN c1 % 4 = c2 % 4 THEN 's' ELSE 'o' END AS class FROM s WHERE c1 IS NOT NULL AND c2 IS NOT NULL")
def starting_classes(spark: SparkSession, d: str) -> DataFrame:
    c1, c2 = F.col("c1"), F.col("c2")
    kind = F.when(F.floor(c1 / 4) == F.floor(c2 / 4), 0).when(c1 % 4 == c2 % 4, 1).otherwise(2)
    return seats(spark, d).filter("c1 is not null and c2 is not null").select("hand_idx", "player_idx", kind.alias("kind"), cards.class_169(c1, c2).alias("class"))


# Evidence


_EV = "WITH ev AS (SELECT pair_id, hand_idx, min(evidence_rank) AS r, max(behavior_family) AS family FROM evidence WHERE evidence_rank >= 1 AND hand_idx IS NOT NULL GROUP BY 1, 2)"


def listed(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "evidence").filter("evidence_rank >= 1 and hand_idx is not null").groupBy("pair_id", "hand_idx")
        .agg(F.min("evidence_rank").alias("r"), F.max("behavior_family").alias("family"))
    )


@query(_EV + ", s AS (SELECT *, round(1.0 / (1 + r), 9) AS sc FROM ev) SELECT pair_id, hand_idx, CAST(row_number() OVER w - 1 AS INTEGER) AS earlier, round(coalesce(sum(sc) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS mass, round(sc * exp(-coalesce(sum(sc) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2), 6) AS decayed, round((row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY pair_id), 6) AS position FROM s WINDOW w AS (PARTITION BY pair_id ORDER BY hand_idx)")
def chronology(spark: SparkSession, d: str) -> DataFrame:
    """Place of a hand among its pair's, the score mass before it, and the score decayed by that."""
    s = listed(spark, d).withColumn("sc", F.round(1.0 / (1 + F.col("r")), 9))
    w = Window.partitionBy("pair_id").orderBy("hand_idx")
    mass = ordered.prefix_sum(F.col("sc"), ["pair_id"], ["hand_idx"])
    return s.select(
        "pair_id", "hand_idx", (F.row_number().over(w) - 1).alias("earlier"), R6(mass).alias("mass"), R6(F.col("sc") * F.exp(-mass / 2)).alias("decayed"),
        R6((F.row_number().over(w) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy("pair_id"))).alias("position"),
    )


@query(_EV + ", l AS (SELECT *, r <= 3 AS listed, max(CASE WHEN r <= 3 THEN hand_idx END) OVER (PARTITION BY pair_id) AS last FROM ev) SELECT pair_id, hand_idx, CAST(CASE WHEN listed THEN 1 WHEN hand_idx < last THEN 0 END AS INTEGER) AS y FROM l")
def censoring_labels(spark: SparkSession, d: str) -> DataFrame:
    """1 for listed hands, 0 for others before the last listed one, unknown after it."""
    l = listed(spark, d).withColumn("last", F.max(F.when(F.col("r") <= 3, F.col("hand_idx"))).over(Window.partitionBy("pair_id")))
    return l.select("pair_id", "hand_idx", F.when(F.col("r") <= 3, 1).when(F.col("hand_idx") < F.col("last"), 0).alias("y"))


_GIVEN = "abs(transfer) + 5 * CASE WHEN (transfer > 0 AND fold_ab > 0) OR (transfer < 0 AND fold_ba > 0) THEN 1 ELSE 0 END"
_SPARED = "10 * CASE WHEN face_ab + face_ba > 0 AND raiseback = 0 THEN 1 ELSE 0 END + 2 * CASE WHEN both_flop THEN 1 ELSE 0 END + CASE WHEN both_vol THEN 1 ELSE 0 END"
_SC = f", lb AS (SELECT DISTINCT pair_id, p1 AS a, p2 AS b FROM labels WHERE pair_id IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL), rs AS (SELECT pair_id, hand_idx, coalesce({_GIVEN}, 0) AS v, {_SPARED} AS w FROM ph JOIN lb USING (a, b)), sc AS (SELECT pair_id, hand_idx, max(round(v / (v + 10), 6)) AS s_a, max(round(w / (w + 10.0), 6)) AS s_b FROM rs GROUP BY 1, 2)"


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, hand_idx, s_a, s_b): of every hand of a labelled pair, how much one gave the other, and how much they spared each
    other, by rules over the pair-hand, as v / (v + 10)."""
    lb = table(spark, d, "labels").filter("pair_id is not null and p1 is not null and p2 is not null").select("pair_id", F.col("p1").alias("a"), F.col("p2").alias("b")).distinct()
    rs = pair_hands(spark, d).join(F.broadcast(lb), ["a", "b"]) if lb.limit(1_000_001).count() <= 1_000_000 else pair_hands(spark, d).join(lb, ["a", "b"])
    rs = rs.withColumns({"v": F.expr(f"coalesce({_GIVEN}, 0)"), "w": F.expr(_SPARED)})
    return rs.groupBy("pair_id", "hand_idx").agg(F.max(F.round(F.col("v") / (F.col("v") + 10), 6)).alias("s_a"), F.max(F.round(F.col("w") / (F.col("w") + 10.0), 6)).alias("s_b"))


@query(_PAIRHAND + _SC + """, po AS (SELECT pair_id, max(CASE WHEN behavior_family = 'soft_play' THEN 0.7 ELSE 0.3 END)::DOUBLE AS pa, 0.3::DOUBLE AS pb FROM labels WHERE pair_id IS NOT NULL GROUP BY 1),
mx AS (SELECT sc.*, round(coalesce(pa / (pa + pb), 0.5) * s_a + coalesce(pb / (pa + pb), 0.5) * s_b, 9) AS mix, greatest(s_a, s_b) AS top FROM sc LEFT JOIN po USING (pair_id)), pl AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY mix DESC, top DESC, hand_idx) AS r FROM mx),
ids AS (SELECT pair_id FROM po UNION SELECT pair_id FROM sc) SELECT ids.pair_id, """ + ", ".join(f"coalesce(max(CASE WHEN r = {i} THEN hand_idx::VARCHAR END), 'NO_EVIDENCE') AS item_{i}" for i in range(1, 6)) + " FROM ids LEFT JOIN pl ON ids.pair_id = pl.pair_id GROUP BY 1")
def compose_top5(spark: SparkSession, d: str) -> DataFrame:
    """Five hands for every pair from a mixture of class scores."""
    p = table(spark, d, "labels").filter("pair_id is not null").groupBy("pair_id").agg(F.max(F.when(F.col("behavior_family") == "soft_play", 0.7).otherwise(0.3)).alias("P_a"))
    return listing.compose(class_scores(spark, d), p.withColumn("P_b", F.lit(0.3)), "pair_id", "hand_idx", ["a", "b"])


@query(_PAIRHAND + _SC + """, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY s_a DESC, hand_idx) AS i FROM sc), g AS (SELECT pair_id, avg(s_a) AS t5 FROM k WHERE i <= 5 GROUP BY 1), w AS (SELECT pair_id, 0.7 * least(greatest((t5 - 0.1) / 0.2, 0), 1) AS w FROM g)
SELECT pair_id, hand_idx, round((1 - w) * s_a + w * s_b, 8) AS blended FROM sc JOIN w USING (pair_id)""")
def gate_ramp_blend(spark: SparkSession, d: str) -> DataFrame:
    """A second score weighs in as far as the pair's five best of the first are strong."""
    s = class_scores(spark, d)
    top = ranking.top_k(s, ["pair_id"], [F.col("s_a").desc(), F.col("hand_idx")], 5).groupBy("pair_id").agg(F.avg("s_a").alias("t5"))
    w = listing.ramp(F.col("t5"), 0.1, 0.3, 0.7)
    return s.join(top, "pair_id").select("pair_id", "hand_idx", F.round((1 - w) * F.col("s_a") + w * F.col("s_b"), 8).alias("blended"))


@query(_EV + ", p AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r, hand_idx) AS truth, row_number() OVER (PARTITION BY pair_id ORDER BY hand_idx) AS guess FROM ev), g AS (SELECT pair_id, CAST(count(*) FILTER (truth <= 5 AND guess <= 5) AS BIGINT) AS common, least(count(*), 5) AS size FROM p GROUP BY 1) SELECT count(*) AS pairs, round(avg((common = size)::INT), 6) AS exact, round(avg(common / size), 6) AS recall FROM g")
def rule_exact_set(spark: SparkSession, d: str) -> DataFrame:
    """How often the rule 'first five in time' gives the very set of five."""
    w = Window.partitionBy("pair_id")
    p = listed(spark, d).withColumns({"truth": F.row_number().over(w.orderBy("r", "hand_idx")), "guess": F.row_number().over(w.orderBy("hand_idx"))})
    g = p.groupBy("pair_id").agg(N((F.col("truth") <= 5) & (F.col("guess") <= 5)).alias("common"), F.least(F.count(F.lit(1)), F.lit(5)).alias("size"))
    return g.agg(F.count(F.lit(1)).alias("pairs"), R6(F.avg((F.col("common") == F.col("size")).cast("int"))).alias("exact"), R6(F.avg(F.col("common") / F.col("size"))).alias("recall"))


@query()
def listing_dp(spark: SparkSession, d: str) -> DataFrame:
    """The chance that each hand is among the five listed, by exact dynamic programming inside a pair."""
    s = class_scores(spark, d).withColumns({"t_1": F.col("s_b"), "t_2": 1 - F.col("s_b")})
    return listing.listing_probabilities(s, "pair_id", ["hand_idx"], "s_a", ["t_1", "t_2"])


@query(_EV + ", p AS (SELECT *, row_number() OVER (PARTITION BY pair_id, family ORDER BY r, hand_idx) AS i FROM ev), q AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY i > 2, r, hand_idx) AS place FROM p) SELECT pair_id, hand_idx, CAST(place AS INTEGER) AS place FROM q WHERE place <= 5")
def quota_lists(spark: SparkSession, d: str) -> DataFrame:
    """Up to two hands a family first, then the rest."""
    i = F.row_number().over(Window.partitionBy("pair_id", "family").orderBy("r", "hand_idx"))
    p = listed(spark, d).withColumn("i", i)
    return ranking.top_k(p, ["pair_id"], [F.col("i") > 2, F.col("r"), F.col("hand_idx")], 5).select("pair_id", "hand_idx", "place")


@query(_EV + f", {HANDS}, g AS (SELECT pair_id, h.t - lag(h.t) OVER (PARTITION BY pair_id ORDER BY h.t, hand_idx) AS gap FROM ev JOIN h USING (hand_idx) WHERE h.t IS NOT NULL) SELECT pair_id, CAST(count(gap) AS BIGINT) AS n, round(median(gap), 3) AS med, round(max(gap), 3) AS high FROM g GROUP BY 1")
def evidence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Time between a pair's hands."""
    t = hands(spark, d).filter("t is not null").select("hand_idx", "t")
    g = listed(spark, d).join(t, "hand_idx").withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("pair_id").orderBy("t", "hand_idx")))
    return g.groupBy("pair_id").agg(F.count("gap").alias("n"), F.round(F.percentile("gap", 0.5), 3).alias("med"), F.round(F.max("gap"), 3).alias("high"))


# Fusion and measures


_RANKS = _LABELLED + f", r AS (SELECT a, b, pos, score, score2, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS r1, (rank() OVER (ORDER BY score2) + (count(*) OVER (PARTITION BY score2) - 1) / 2) / count(*) OVER () AS r2 FROM y)"


def fused(spark: SparkSession, d: str) -> DataFrame:
    y = labelled(spark, d)
    n = y.agg(F.count(F.lit(1)).alias("__n"))
    y = ordered.global_average_rank(ordered.global_average_rank(y, "score", "r1"), "score2", "r2")
    return y.crossJoin(F.broadcast(n)).withColumns({"r1": F.col("r1") / F.col("__n"), "r2": F.col("r2") / F.col("__n")}).drop("__n")  # one row


@query(_RANKS + " SELECT a, b, round((r1 + r2) / 2, 6) AS mean, round(0.7 * r1 + 0.3 * r2, 6) AS weighted, round(greatest(r1, r2), 6) AS top FROM r")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    r1, r2 = F.col("r1"), F.col("r2")
    return fused(spark, d).select("a", "b", R6((r1 + r2) / 2).alias("mean"), R6(0.7 * r1 + 0.3 * r2).alias("weighted"), R6(F.greatest(r1, r2)).alias("top"))


_AP = "coalesce(sum(CASE WHEN pos THEN hits::DOUBLE / i ELSE 0 END) / nullif(sum(pos::INT), 0), 0)"


@query(_LABELLED + f", o AS (SELECT pos, row_number() OVER w AS i, sum(pos::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM y WINDOW w AS (ORDER BY score DESC, {_KEY})) SELECT round({_AP}, 6) AS ap FROM o")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(labelled(spark, d).withColumn("key", KEY()), "score", "pos", "key").select(R6("ap").alias("ap"))


@query(_LABELLED + f""", f AS (SELECT DISTINCT family FROM y WHERE family IS NOT NULL AND family <> 'none'), x2 AS (SELECT f.family AS target, {_KEY} AS k, y.family = f.family AND pos AS pos, CASE WHEN (score2 > 0.05) = (f.family = 'soft_play') THEN score ELSE 0 END AS sc FROM y, f WHERE y.family IS NOT NULL),
o AS (SELECT target, pos, row_number() OVER w AS i, sum(pos::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM x2 WINDOW w AS (PARTITION BY target ORDER BY sc DESC, k)) SELECT target, round({_AP}, 6) AS ap FROM o GROUP BY 1""")
def behaviour_ap(spark: SparkSession, d: str) -> DataFrame:
    """Average precision by family, a pair's score being 0 where another family is predicted."""
    y = labelled(spark, d).filter("family is not null").withColumn("key", KEY())
    f = y.filter("family <> 'none'").select(F.col("family").alias("target")).distinct()
    x = y.crossJoin(F.broadcast(f)).withColumn("hit", (F.col("family") == F.col("target")) & F.col("pos"))  # a handful of families
    x = x.withColumn("sc", F.when((F.col("score2") > 0.05) == (F.col("target") == "soft_play"), F.col("score")).otherwise(0.0))
    return metrics.average_precision(x, "sc", "hit", "key", ["target"]).select("target", R6("ap").alias("ap"))


@query(_EV + ", p AS (SELECT pair_id, r <= 3 AS rel, count(*) FILTER (r <= 3) OVER (PARTITION BY pair_id) AS total, row_number() OVER (PARTITION BY pair_id ORDER BY hand_idx) AS place FROM ev), h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY pair_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS hits FROM p WHERE place <= 5), g AS (SELECT pair_id, sum(CASE WHEN rel THEN hits::DOUBLE / place ELSE 0 END) / nullif(least(max(total), 5), 0) AS ap FROM h GROUP BY 1) SELECT count(*) AS pairs, round(avg(coalesce(ap, 0)), 6) AS map5 FROM g")
def map_at_5(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("pair_id")
    p = listed(spark, d).withColumns({"rel": F.col("r") <= 3, "place": F.row_number().over(w.orderBy("hand_idx")), "total": N(F.col("r") <= 3).over(w)})
    g = metrics.precision_at(p, "pair_id", "place", "rel", "total", 5)
    return g.agg(F.count(F.lit(1)).alias("pairs"), R6(F.avg(F.coalesce("ap", F.lit(0.0)))).alias("map5"))


@query(_RANKS.replace("/ count(*) OVER () AS r1", "AS r1") + " SELECT round((sum(r1) FILTER (pos) - sum(pos::INT) * (sum(pos::INT) + 1) / 2) / (sum(pos::INT) * sum((NOT pos)::INT)), 6) AS auc FROM r")
def auc_ranks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(labelled(spark, d), "score", "pos").select(R6("auc").alias("auc"))


_P = "least(greatest(score, 1e-6), 1 - 1e-6)"


@query(_LABELLED + f" SELECT count(*) AS n, round(avg(-CASE WHEN pos THEN ln({_P}) ELSE ln(1 - {_P}) END), 6) AS logloss, round(avg((({_P} >= 0.5) = pos)::INT), 6) AS accuracy, round(-(avg(pos::INT) * ln(avg(pos::INT)) + (1 - avg(pos::INT)) * ln(1 - avg(pos::INT))), 6) AS base_logloss FROM y")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.log_loss(labelled(spark, d), "score", "pos")
    return m.select("n", *(R6(c).alias(c) for c in ("logloss", "accuracy", "base_logloss")))


@query(_LABELLED + " SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_p, round(avg(pos::INT), 6) AS share FROM y GROUP BY 1")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration(labelled(spark, d), "score", "pos", 10).select("bin", "n", R6("mean_p").alias("mean_p"), R6("share").alias("share"))


@query(_LABELLED + ", q AS (SELECT quantile_cont(score, 0.9) AS q FROM y WHERE NOT pos) SELECT round(avg((score > q)::INT), 6) AS recall FROM y, q WHERE pos")
def recall_at_negative_quantile(spark: SparkSession, d: str) -> DataFrame:
    y = labelled(spark, d)
    q = y.filter(~F.col("pos")).agg(F.percentile("score", 0.9).alias("q"))
    return y.filter("pos").crossJoin(F.broadcast(q)).agg(R6(F.avg((F.col("score") > F.col("q")).cast("int"))).alias("recall"))  # one row


@query(_LABELLED + " SELECT family, round(avg((flow > 0)::INT), 6) AS any_flow, round(avg((score > 0.2)::INT), 6) AS high, count(*) AS n FROM y GROUP BY 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy("family").agg(R6(F.avg((F.col("flow") > 0).cast("int"))).alias("any_flow"), R6(F.avg((F.col("score") > 0.2).cast("int"))).alias("high"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (p1 IS NULL OR p2 IS NULL) AS BIGINT) AS unresolved, CAST(count(*) FILTER (p1 >= p2) AS BIGINT) AS misordered, CAST(count(*) - count(DISTINCT pair_id) AS BIGINT) AS repeated, CAST(count(*) FILTER (label NOT IN (0, 1)) AS BIGINT) AS bad_label, CAST(count(*) FILTER (label = 1 AND behavior_family IS NULL) AS BIGINT) AS no_family FROM labels")
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(
        F.count(F.lit(1)).alias("n"), N(F.col("p1").isNull() | F.col("p2").isNull()).alias("unresolved"), N(F.col("p1") >= F.col("p2")).alias("misordered"),
        (F.count(F.lit(1)) - F.count_distinct("pair_id")).alias("repeated"), N(~F.col("label").isin(0, 1)).alias("bad_label"), N((F.col("label") == 1) & F.col("behavior_family").isNull()).alias("no_family"),
    )


@query()
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Whether one score is better than the other over resampled pairs."""
    y = labelled(spark, d).withColumn("key", KEY())
    side = F.when(F.col("pos"), 1.0).otherwise(-1.0)
    return metrics.paired_bootstrap(y.withColumns({"u": side * F.col("score2"), "v": side * F.col("score")}), "key", "u", "v", 500)


# Models


FEATURES = ["n", "flow", "sd", "score", "score2"]


def model_rows(spark: SparkSession, d: str, how: str = "inner") -> DataFrame:
    """Pairs with a label (or all, how = "left"), a fold that all pairs of a table share, and a weight. A pair's table is the
    smallest at which both sat."""
    at = pair_stats(spark, d).groupBy("a", "b").agg(F.min("table_idx").alias("at"))
    y = labelled(spark, d, how).join(at, ["a", "b"])
    y = y.withColumns({"label": F.col("pos").cast("double"), "fold": F.pmod(F.xxhash64("at"), F.lit(2)).cast("int"), "w": F.when(F.col("pos"), 5.0).otherwise(1.0)})
    return cut(y)  # several passes follow


@query()
def cross_fitted_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Weighted logistic regression, each half scored by the other's model, then Platt-scaled."""
    s = models.cross_fit(model_rows(spark, d), FEATURES, "fold", 2, "label", "logistic", "w").withColumn("p", F.get("probability", F.lit(1)))
    slope, intercept = models.platt(s.select("p", "label"), "p", "label")
    return s.select("a", "b", "p", models.platt_scaled(F.col("p"), slope, intercept).alias("scaled"))


@query()
def cross_fitted_forest(spark: SparkSession, d: str) -> DataFrame:
    """A random forest over families, the mean of two seeds."""
    rows = model_rows(spark, d)
    code = F.when(F.col("family") == "directed_transfer", 1.0).when(F.col("family") == "soft_play", 2.0).when(F.col("family") == "coordinated_isolation", 3.0).otherwise(0.0)
    return models.cross_fit(rows.withColumn("label", code), FEATURES, "fold", 2, "label", "forest", seeds=(1, 2)).select("a", "b", "probability")


@query()
def cross_fitted_trees(spark: SparkSession, d: str) -> DataFrame:
    return models.cross_fit(model_rows(spark, d), FEATURES, "fold", 2, "label", "trees", "w").select("a", "b", F.get("probability", F.lit(1)).alias("p"))


@query()
def player_logits(spark: SparkSession, d: str) -> DataFrame:
    """A ridge logit of folding for every player, offset by the population's rate in the same state."""
    s = states(spark, d).filter("to_call > 0").withColumns({"fold": (F.col("action") == 0).cast("int"), "k": F.least("nr", F.lit(3))})
    p = s.groupBy("street", "k").agg(F.avg("fold").alias("p"))
    offset = F.ln(F.greatest(F.col("p"), F.lit(1e-4)) / F.greatest(1 - F.col("p"), F.lit(1e-4)))
    return models.entity_logits(s.join(F.broadcast(p), ["street", "k"]).withColumn("offset", F.round(offset, 6)), "player_idx", "fold", "offset", ["street", "k"])  # 16 cells


@query()
def pair_clusters(spark: SparkSession, d: str) -> DataFrame:
    return models.clusters(model_rows(spark, d), FEATURES, 4).select("a", "b", "cluster")
