"""Pair-hand features, signature flags and the directed event catalogue, and their SQL.

The catalogues of conditions are shared with the SQL, which brings together steps, seats and hands in its own way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.operators import eventarrays as A
from tarn.operators import events as E
from tarn.operators import handarrays, pairarrays
from tarn.operators import pairhand as P
from tarn.operators import replay as R
from tarn.plans.lineage import cut
from tarn.queries.base import ACTIONS, HANDS, SEATS
from tarn.sources.handlog import is_step, seconds
from tarn.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def whole_hands(spark: SparkSession, d: str) -> DataFrame:
    """One row per hand with its fields, board and time."""
    fields = ["table_idx", "hand_seq", "phase", "button_seat", "sb", "bb", "final_pot", "board"]
    clean = table(spark, d, "hands").filter("hand_idx is not null").withColumn("t", seconds(F.col("ts")))
    return clean.groupBy("hand_idx").agg(*(F.max(c).alias(c) for c in [*fields, "t"])).filter("bb > 0")


def hand_log(spark: SparkSession, d: str, tables: list[int] | None = None) -> DataFrame:
    """hand_rows() of the whole log, or of some tables, written once: the rates and the meetings read it."""
    hands = whole_hands(spark, d)
    hands = hands if tables is None else hands.filter(F.col("table_idx").isin(tables))
    return cut(P.hand_rows(hands, table(spark, d, "seats"), table(spark, d, "actions").filter(is_step())))


def met(spark: SparkSession, d: str) -> DataFrame:
    h = hand_log(spark, d)
    return P.meetings(h, P.population_rates(h))


_AGG = P.AGGR.replace("action", "a.action").replace("amount", "a.amount").replace("to_call", "a.to_call")
_CAL = P.CALL.replace("action", "a.action").replace("amount", "a.amount").replace("to_call", "a.to_call")
_CLS = """CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN substr('23456789TJQKA', CAST(greatest(c1 // 4, c2 // 4) AS INTEGER) + 1, 1) || substr('23456789TJQKA', CAST(least(c1 // 4, c2 // 4) AS INTEGER) + 1, 1)
|| CASE WHEN c1 // 4 = c2 // 4 THEN '' WHEN c1 % 4 = c2 % 4 THEN 's' ELSE 'o' END END"""
_BEFORE = "ORDER BY action_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SEATED = f"""WITH {HANDS}, {SEATS}, {ACTIONS}, bd AS (SELECT hand_idx, max(len(board)) AS nb FROM hands WHERE hand_idx IS NOT NULL GROUP BY 1),
t0 AS (SELECT a.*, coalesce({_AGG}, false) AS aggr, coalesce({_CAL}, false) AS calls, a.action = 0 AS isfold FROM a),
t1 AS (SELECT *, coalesce(sum(aggr::INT) OVER ws, 0) AS nr, last_value(CASE WHEN aggr THEN player_idx END IGNORE NULLS) OVER ws AS l, coalesce(last_value(CASE WHEN aggr THEN action = 5 END IGNORE NULLS) OVER ws, false) AS lall,
coalesce(sum(aggr::INT) OVER (PARTITION BY hand_idx, street, player_idx {_BEFORE}), 0) > 0 AS xagg, (street = 0 AND (aggr OR calls)) AND coalesce(sum((street = 0 AND (aggr OR calls))::INT) OVER (PARTITION BY hand_idx, player_idx {_BEFORE}), 0) = 0 AS v1,
coalesce(sum((calls AND street = 0)::INT) OVER wh, 0) AS nc, coalesce(sum(isfold::INT) OVER wh, 0) AS nf FROM t0 WINDOW ws AS (PARTITION BY hand_idx, street {_BEFORE}), wh AS (PARTITION BY hand_idx {_BEFORE})),
st AS (SELECT *, coalesce(sum(v1::INT) OVER wh, 0) AS nvol, coalesce(sum((calls AND street = 0 AND nr > 0)::INT) OVER wh, 0) AS cao FROM t1 WINDOW wh AS (PARTITION BY hand_idx {_BEFORE})),
sm AS (SELECT hand_idx, player_idx, min(action_no) FILTER (street = 0) AS first_no, min(action_no) FILTER (isfold) AS fold_no, min(action_no) FILTER (street = 0 AND (aggr OR calls)) AS vol_no, min(action_no) FILTER (aggr) AS aggr_no,
min(action_no) FILTER (street = 0 AND aggr) AS pfr_no, bool_or(street = 0 AND action = 5) AS allin FROM st GROUP BY 1, 2),
se AS (SELECT s.hand_idx, s.player_idx AS p, ((s.seat_no - h.button_seat) % 6 + 6) % 6 AS pos, net_chips AS net, coalesce(went_to_showdown, false) AS sd, total_contribution AS con, s.seat_no, c1, c2, {_CLS} AS cls, first_no, fold_no, vol_no, aggr_no, pfr_no,
coalesce(allin, false) AS allin, f.street AS fold_st, g.action AS first_act, g.l AS first_l, CASE WHEN g.calls AND g.nr = 0 THEN first_no END AS limp_no, h.table_idx, h.hand_seq, h.phase, h.bb, h.final_pot, h.t, count(*) OVER (PARTITION BY s.hand_idx) AS ns
FROM s JOIN h ON h.hand_idx = s.hand_idx AND h.bb > 0 LEFT JOIN sm ON sm.hand_idx = s.hand_idx AND sm.player_idx = s.player_idx LEFT JOIN st f ON f.hand_idx = s.hand_idx AND f.action_no = sm.fold_no LEFT JOIN st g ON g.hand_idx = s.hand_idx AND g.action_no = sm.first_no),
rc AS (SELECT cls, least(nr, 3) AS nr, pos, least(nc, 2) AS nc, count(*) AS n, sum(aggr::INT) AS ka, sum(isfold::INT) AS kf, sum(calls::INT) AS kc FROM st JOIN se ON se.hand_idx = st.hand_idx AND se.p = st.player_idx WHERE street = 0 AND cls IS NOT NULL AND pos IS NOT NULL GROUP BY 1, 2, 3, 4),
rates AS (SELECT cls, nr, pos, nc, n, """ + ", ".join(f"CASE WHEN n >= {P.LEAST_CELL} THEN {k}::DOUBLE / n ELSE sum({k}) OVER (PARTITION BY cls, nr)::DOUBLE / sum(n) OVER (PARTITION BY cls, nr) END AS {p}" for k, p in (("ka", "p_aggr"), ("kf", "p_fold"), ("kc", "p_call"))) + """ FROM rc)"""
_XY = SEATED + """, op AS (SELECT hand_idx, player_idx AS opener, nvol = 0 AS unopened FROM st QUALIFY row_number() OVER (PARTITION BY hand_idx ORDER BY NOT (street = 0 AND aggr), action_no) = 1 AND street = 0 AND aggr),
ts AS (SELECT hand_idx, street, min(action_no) AS k, bool_or(aggr) AS aggr FROM st GROUP BY 1, 2), tl AS (SELECT ts.*, (SELECT count(*) FROM se w WHERE w.hand_idx = ts.hand_idx AND coalesce(w.fold_no >= ts.k, true)) AS n0 FROM ts),
pp AS (SELECT x.hand_idx, x.p AS x, y.p AS y, x.fold_no AS xf, y.fold_no AS yf FROM se x JOIN se y ON x.hand_idx = y.hand_idx AND x.p <> y.p),
sp AS (SELECT pp.hand_idx, x, y, count(*) AS both_st, count(*) FILTER (street > 0 AND n0 = 2) AS hu_st, count(*) FILTER (street > 0 AND n0 = 2 AND NOT aggr) AS hu_still, count(*) FILTER (street > 0 AND n0 >= 3) AS mw_st, count(*) FILTER (street > 0 AND n0 >= 3 AND NOT aggr) AS mw_still
FROM pp JOIN tl ON tl.hand_idx = pp.hand_idx AND coalesce(xf >= k, true) AND coalesce(yf >= k, true) GROUP BY 1, 2, 3),
tf AS (SELECT pp.hand_idx, x, y, count(*) AS tf, count(*) FILTER (street = 0) AS tf_pre, count(*) FILTER (coalesce(yf > action_no, true)) AS tf_act FROM pp JOIN st ON st.hand_idx = pp.hand_idx AND isfold AND l = x AND player_idx <> x AND player_idx <> y GROUP BY 1, 2, 3),
en AS (SELECT hand_idx, action_no AS k, player_idx AS p, aggr FROM st WHERE street = 0 AND (aggr OR calls)),
sd AS (SELECT DISTINCT a.hand_idx, least(a.p, b.p) AS a, greatest(a.p, b.p) AS b FROM en a JOIN en b ON a.hand_idx = b.hand_idx AND a.aggr AND b.aggr AND b.k < a.k AND a.p <> b.p
WHERE NOT EXISTS (SELECT 1 FROM en c WHERE c.hand_idx = a.hand_idx AND c.aggr AND c.k > b.k AND c.k < a.k AND c.p IN (a.p, b.p)) AND EXISTS (SELECT 1 FROM en z WHERE z.hand_idx = a.hand_idx AND z.k > b.k AND z.k < a.k AND z.p NOT IN (a.p, b.p))),
hh AS (SELECT se.hand_idx, count(*) FILTER (vol_no IS NOT NULL) AS nvols, count(*) FILTER (fold_no IS NULL) AS nleft, max(nb) AS nb, list(p) AS members FROM se JOIN bd USING (hand_idx) GROUP BY 1), np AS (SELECT hand_idx, count(*) AS npre FROM st WHERE street = 0 GROUP BY 1),
nx AS (SELECT table_idx, hand_seq, list(DISTINCT p) AS members FROM se WHERE table_idx IS NOT NULL AND hand_seq IS NOT NULL GROUP BY 1, 2),
xy AS (SELECT x.hand_idx, x.table_idx, x.hand_seq, x.phase, x.bb, x.final_pot, a.action_no IS NULL AS s, a.action_no AS k, a.street, a.action AS act, a.amount, a.to_call AS tc, a.pot_before AS pot, a.aggr, a.calls, a.isfold, a.nr, a.l, a.lall, a.xagg, a.nvol, a.cao,
x.p AS x, y.p AS y, x.pos AS xpos, y.pos AS ypos, x.cls AS xcls, y.cls AS ycls, p_aggr AS pa, p_fold AS pf, p_call AS pc, x.ns - a.nf AS nact, coalesce(a.action_no = x.first_no, false) AS first, coalesce(y.fold_no > a.action_no, true) AS ya, coalesce(y.first_no < a.action_no, false) AS yd,
coalesce(y.vol_no < a.action_no, false) AS yv, coalesce(y.limp_no < a.action_no, false) AS yl, coalesce(a.action_no = x.pfr_no, false) AS pfirst, opener, coalesce(unopened, false) AS unopened, coalesce(x.net, 0) AS xnet, coalesce(y.net, 0) AS ynet, x.sd AS xsd, y.sd AS ysd, coalesce(x.con, 0) AS xcon,
x.vol_no IS NOT NULL AS xvol, y.vol_no IS NOT NULL AS yvol, x.pfr_no IS NOT NULL AS xpfr, x.allin AS xallin, coalesce(x.fold_st, 9) AS xfold_st, coalesce(y.fold_st, 9) AS yfold_st, x.first_act AS xfirst_act, x.first_l AS xfirst_l, x.pfr_no AS xpfr_no, x.fold_no AS xfold_no, y.aggr_no AS yaggr_no,
y.first_no AS yfirst_no, x.seat_no AS xseat, y.seat_no AS yseat, coalesce(nb, 0) AS nb, nvols, coalesce(npre, 0) AS npre, nleft, EXISTS (SELECT 1 FROM se w WHERE w.hand_idx = x.hand_idx AND w.p <> x.p AND w.p <> y.p AND coalesce(w.con, 0) >= 3 * x.bb) AS big3, sd.a IS NOT NULL AS sandwich, coalesce(both_st, 0) AS both_st,
coalesce(hu_st, 0) AS hu_st, coalesce(hu_still, 0) AS hu_still, coalesce(mw_st, 0) AS mw_st, coalesce(mw_still, 0) AS mw_still, coalesce(tf, 0) AS tf, coalesce(tf_pre, 0) AS tf_pre, coalesce(tf_act, 0) AS tf_act,
coalesce(NOT list_contains(nb4.members, x.p), false) AS xnew, coalesce(NOT list_contains(nb4.members, y.p), false) AS ynew, coalesce(NOT list_contains(naf.members, x.p), false) AS xgone, coalesce(NOT list_contains(naf.members, y.p), false) AS ygone
FROM (SELECT hand_idx, player_idx, action_no, street, action, amount, to_call, pot_before, aggr, calls, isfold, nr, nc, l, lall, xagg, nvol, cao, nf FROM st UNION ALL SELECT hand_idx, p, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM se) a
JOIN se x ON x.hand_idx = a.hand_idx AND x.p = a.player_idx JOIN se y ON y.hand_idx = x.hand_idx AND y.p <> x.p LEFT JOIN rates r ON a.street = 0 AND r.cls = x.cls AND r.nr = least(a.nr, 3) AND r.pos = x.pos AND r.nc = least(a.nc, 2)
LEFT JOIN op ON op.hand_idx = x.hand_idx LEFT JOIN sp ON sp.hand_idx = x.hand_idx AND sp.x = x.p AND sp.y = y.p LEFT JOIN tf ON tf.hand_idx = x.hand_idx AND tf.x = x.p AND tf.y = y.p LEFT JOIN sd ON sd.hand_idx = x.hand_idx AND sd.a = least(x.p, y.p) AND sd.b = greatest(x.p, y.p)
JOIN hh ON hh.hand_idx = x.hand_idx LEFT JOIN np ON np.hand_idx = x.hand_idx LEFT JOIN nx nb4 ON nb4.table_idx = x.table_idx AND nb4.hand_seq = x.hand_seq - 1 LEFT JOIN nx naf ON naf.table_idx = x.table_idx AND naf.hand_seq = x.hand_seq + 1)"""
_DIR = _XY + ", dr AS (SELECT hand_idx, x, y, " + ", ".join(f"{e} AS {c}" for c, e in (P.FEATURES | P.COMMON).items()) + " FROM xy GROUP BY 1, 2, 3)"
_PH = _DIR + ", ph AS (SELECT x.hand_idx, x.x AS a, x.y AS b, " + ", ".join(f"{e} AS {c}" for c, e in P.paired_columns().items()) + " FROM dr x JOIN dr y ON x.hand_idx = y.hand_idx AND x.x = y.y AND x.y = y.x AND x.x < x.y)"


def _rounded(columns: dict[str, str] | list[str], floats: tuple[str, ...] = ("net_bb", "pot_bb", "min_p", "minpa", "fpa_p")) -> list[tuple[str, bool]]:
    return [(c, c.startswith(floats)) for c in columns]


def paired(spark: SparkSession, d: str) -> DataFrame:
    """Pair-hands with all features that need no equity."""
    return P.pairs(P.directed(met(spark, d)))


@query(_PH + " SELECT hand_idx, a, b, " + ", ".join(f"round({c}, 6) AS {c}" if r else c for c, r in _rounded(P.paired_columns())) + " FROM ph")
def pair_hand_features(spark: SparkSession, d: str) -> DataFrame:
    """The pair-hand engine: every pair of seats of every hand, symmetric features and those of each towards the other."""
    return paired(spark, d).select("hand_idx", "a", "b", *((F.round(c, 6).alias(c) if r else F.col(c)) for c, r in _rounded(P.paired_columns())))


_FLAGS = ", fl AS (SELECT a, b, count(*) AS n, " + ", ".join([f"sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS c_{k}" for k, e in P.flags().items()] + [f"sum({e}) AS s_{k}" for k, e in P.sums().items()]) + " FROM ph GROUP BY 1, 2), "
_BASE = "bs AS (SELECT " + ", ".join(f"sum(c_{k})::DOUBLE / sum(n) AS p_{k}" for k in P.flags()) + " FROM fl)"


@query(_PH + _FLAGS + _BASE + " SELECT a, b, n, " + ", ".join(f"round({e}, 7) AS {c}" for c, e in P.signature_columns().items()) + " FROM fl, bs")
def pair_signature_table(spark: SparkSession, d: str) -> DataFrame:
    """Rates, binomial z and asymmetries of the signature flags for every pair."""
    s = P.pair_signatures(paired(spark, d), ["a", "b"])
    return s.select("a", "b", "n", *(F.round(c, 7).alias(c) for c in P.signature_columns()))


@query(SEATED + " SELECT cls, CAST(nr AS INTEGER) AS nr, CAST(pos AS INTEGER) AS pos, CAST(nc AS INTEGER) AS nc, n, round(p_aggr, 6) AS p_aggr, round(p_fold, 6) AS p_fold, round(p_call, 6) AS p_call FROM rates")
def starting_hand_rates(spark: SparkSession, d: str) -> DataFrame:
    """What players do before the flop with a starting hand, by raises, place and callers, falling back where rows are few."""
    r = P.population_rates(hand_log(spark, d))
    return r.select("cls", F.col("nr").cast("int").alias("nr"), "pos", F.col("nc").cast("int").alias("nc"), "n", *(F.round(c, 6).alias(c) for c in ("p_aggr", "p_fold", "p_call")))


# Directed events


_SINCE = {"xnew": "prior is not null and not array_contains(prior, x.p)", "ynew": "prior is not null and not array_contains(prior, y.p)", "xgone": "later is not null and not array_contains(later, x.p)", "ygone": "later is not null and not array_contains(later, y.p)"}


def lined_up(h: DataFrame) -> DataFrame:
    """Hands with the players of the hand before and after at their table, null if that hand is not in the log."""
    own = h.filter("table_idx is not null and hand_seq is not null").select("table_idx", "hand_seq", F.explode("seats.p").alias("p")).groupBy("table_idx", "hand_seq").agg(F.collect_set("p").alias("m"))
    for name, step in (("prior", 1), ("later", -1)):
        h = h.join(own.select("table_idx", (F.col("hand_seq") + step).alias("hand_seq"), F.col("m").alias(name)), ["table_idx", "hand_seq"], "left")
    return h


def event_totals(spark: SparkSession, d: str, tables: list[int] | None = None) -> DataFrame:
    """Event counts of all tables, or of some."""
    h = hand_log(spark, d, tables)
    return E.event_counts(E.event_masks(P.meetings(lined_up(h), P.population_rates(h), more=_SINCE)))


def table_hands(spark: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    """Hands of tables that fit a task, for by_table(), and the numbers of the other tables."""
    hands = whole_hands(spark, d).filter("table_idx is not null")
    hot = A.hot_tables(hands.select("hand_idx", "table_idx"))
    cool = hands.filter(~F.col("table_idx").isin(hot)) if hot else hands
    fields = ["hand_idx", "table_idx", "hand_seq", "phase", "button_seat", "bb", "board"]
    return handarrays.gathered(cool.select(*fields), table(spark, d, "seats"), table(spark, d, "actions").filter(is_step())), hot


_COUNTS = _XY + f""", em AS (SELECT hand_idx, table_idx, hand_seq, phase, x, y, bit_or({E.mask(E.EVENTS, False)}) AS opp, bit_or({E.mask(E.EVENTS, True)}) AS hit FROM xy WHERE table_idx IS NOT NULL GROUP BY ALL),
ew AS (SELECT w."window", em.* FROM em JOIN (VALUES {", ".join(f"('{n}')" for n in E.WINDOWS)}) w("window") ON CASE w."window" {" ".join(f"WHEN '{n}' THEN {E.in_window(w)}" for n, w in E.WINDOWS.items())} END),
ec AS (SELECT "window", table_idx, x, y, event, CAST(sum((opp >> i) & 1) AS BIGINT) AS opp, CAST(sum((hit >> i) & 1) AS BIGINT) AS hit FROM ew, (VALUES {", ".join(f"({i}, '{e}')" for i, e in enumerate(E.EVENTS))}) v(i, event) GROUP BY ALL HAVING sum((opp >> i) & 1) > 0)"""
_SCORES = _COUNTS + f""", e0 AS (SELECT *, greatest(sum(hit) OVER w::DOUBLE / sum(opp) OVER w, 1e-6) AS p FROM ec WINDOW w AS (PARTITION BY "window", table_idx, event)),
e1 AS (SELECT *, (sum(hit) OVER wx - hit + {E.SHRINK} * p) / (sum(opp) OVER wx - opp + {E.SHRINK}) AS px, (sum(hit) OVER wy - hit + {E.SHRINK} * p) / (sum(opp) OVER wy - opp + {E.SHRINK}) AS py FROM e0 WINDOW wx AS (PARTITION BY "window", table_idx, event, x), wy AS (PARTITION BY "window", table_idx, event, y)),
e2 AS (SELECT *, opp * least(px * py / p, 1) AS expected, greatest(opp * least(px * py / p, 1), {E.FLOOR}) AS f FROM e1),
e3 AS (SELECT *, sign(hit - f) * 2 * greatest(CASE WHEN hit > 0 THEN hit * ln(hit / f) ELSE 0 END - (hit - f), 0) AS g, round(ln((hit + 1) / (expected + 1)), 9) AS l FROM e2),
sc AS (SELECT *, l = max(l) OVER (PARTITION BY "window", table_idx, event, x) AS row_top, l = max(l) OVER (PARTITION BY "window", table_idx, event, y) AS col_top FROM e3),
bw AS (SELECT "window", table_idx, least(x, y) AS a, greatest(x, y) AS b, event, """ + ", ".join(f"coalesce(max({c}) FILTER (x {o} y), {none}) AS {n}_{d}" for d, o in (("ab", "<"), ("ba", ">")) for c, n, none in (("g", "g", "0"), ("row_top", "rt", "false"), ("col_top", "ct", "false"))) + " FROM sc GROUP BY 1, 2, 3, 4, 5)"
_TOP = "(CASE WHEN g_ab >= g_ba THEN rt_ab AND ct_ab ELSE rt_ba AND ct_ba END)"
_G = "greatest(g_ab, g_ba)"


@query(_COUNTS + " SELECT * FROM ec")
def event_table(spark: SparkSession, d: str) -> DataFrame:
    """Opportunities and hits of 46 events, from every player to every co-player, by window and table."""
    return event_totals(spark, d)


@query(_SCORES + f""" SELECT "window", table_idx, a, b, """ + ", ".join(f"count(*) FILTER ({_G} >= {k} AND {_TOP}) AS k{k}" for k in (6, 10, 16)) + f""", round(sum(least(greatest({_G}, 0), {E.CAP})), 3) AS g_pos, round(sum(CASE WHEN {_TOP} THEN least(greatest({_G}, 0), {E.CAP}) ELSE 0 END), 3) AS g_top,
round(max({_G}), 3) AS g_max, round(sum(least(greatest(least(g_ab, g_ba), 0), {E.CAP})), 3) AS g_sym FROM bw WHERE event NOT IN ({", ".join(f"'{e}'" for e in E.NOT_MINED)}) GROUP BY 1, 2, 3, 4""")
def multi_event_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a pair over all events: how many stand out at the top of both lists, and sums and maximum of the deviances."""
    cool, hot = table_hands(spark, d)
    m = A.by_table(cool, A.mined, A.MINED)
    if hot:
        m = m.unionByName(E.mined(E.both_ways(E.event_scores(event_totals(spark, d, hot)))))
    return m.select("window", "table_idx", "a", "b", "k6", "k10", "k16", *(F.round(c, 3).alias(c) for c in ("g_pos", "g_top", "g_max", "g_sym")))


_FLAGGED = _SCORES + ", fg AS (" + " UNION ALL ".join(f"""SELECT "window", table_idx, a, b, event, '{f}' AS flag FROM bw WHERE {e}""" for f, e in E.tail_flags().items()) + ")"


@query(_FLAGGED + """, pf AS (SELECT event, flag, table_idx, a, b, bool_or("window" = 'first') AS one, bool_or("window" = 'second') AS two FROM fg WHERE "window" IN ('first', 'second') GROUP BY ALL)
SELECT event, flag, count(*) FILTER (one AND NOT two) AS first_only, count(*) FILTER (two AND NOT one) AS second_only, count(*) FILTER (one AND two) AS both_phases, round((count(*) FILTER (two AND NOT one) - count(*) FILTER (one AND NOT two)) / sqrt(greatest(count(*) FILTER (one <> two), 1)), 6) AS z FROM pf GROUP BY 1, 2""")
def phase_excess(spark: SparkSession, d: str) -> DataFrame:
    """For every event and tail flag, pairs flagged in one phase only, and McNemar's z of the second phase against the first."""
    f = E.flagged(E.both_ways(E.event_scores(event_totals(spark, d)))).filter("window in ('first', 'second')")
    has = lambda w: F.bool_or(F.col("window") == w)
    p = f.groupBy("event", "flag", "table_idx", "a", "b").agg(has("first").alias("one"), has("second").alias("two"))
    one, two = F.count_if(F.col("one") & ~F.col("two")), F.count_if(F.col("two") & ~F.col("one"))
    return p.groupBy("event", "flag").agg(one.alias("first_only"), two.alias("second_only"), F.count_if(F.col("one") & F.col("two")).alias("both_phases"), F.round((two - one) / F.sqrt(F.greatest(one + two, F.lit(1))), 6).alias("z"))


@query()
def event_excess(spark: SparkSession, d: str) -> DataFrame:
    """Pairs flagged per event and tail flag, beside three nulls: the same pairs redrawn under independence, the share among
    labelled negatives carried over to all pairs, and the other phase."""
    cool, hot = table_hands(spark, d)
    found = A.by_table(cool, A.flagged, A.FLAGGED)
    if hot:
        scores = cut(E.event_scores(event_totals(spark, d, hot)))
        kinds = {"pair": scores.filter("window = 'first'").select("table_idx", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()}
        kinds["redrawn"] = E.flagged(E.both_ways(E.event_scores(E.redrawn(scores)))).filter("window = 'first'")
        more = [E.flagged(E.both_ways(scores)).withColumnRenamed("window", "kind")] + [r.withColumn("kind", F.lit(k)) for k, r in kinds.items()]
        for rows in more:
            found = found.unionByName(rows.select("table_idx", "a", "b", "kind", *(c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("event", "flag"))))
    lab = table(spark, d, "labels").filter("label = 0 and p1 is not null and p2 is not null").select(F.col("p1").alias("a"), F.col("p2").alias("b")).distinct().withColumn("neg", F.lit(True))
    some = cut(found.join(lab, ["a", "b"], "left").groupBy("kind", "event", "flag").agg(F.count(F.lit(1)).alias("n"), F.count("neg").alias("k")))
    size = some.filter("kind = 'pair'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("k"), F.lit(0)).alias("negatives"))
    null = some.filter("kind = 'redrawn'").select("event", "flag", F.col("n").alias("redrawn"))
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    counts = some.filter("kind not in ('pair', 'redrawn')").groupBy("event", "flag").agg(of("first", "n").alias("seen"), of("second", "n").alias("other_phase"), of("first", "k").alias("k"))
    out = counts.join(null, ["event", "flag"], "full").crossJoin(F.broadcast(size))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    carried = F.coalesce(F.try_divide(zero("k") * F.col("pairs"), F.col("negatives")), F.lit(0.0))
    return out.select("event", "flag", zero("seen").alias("seen"), zero("redrawn").alias("redrawn"), carried.alias("from_negatives"), zero("other_phase").alias("other_phase"), (zero("seen") - F.greatest(zero("redrawn"), carried)).alias("excess"))


# With equities


def replayed(spark: SparkSession, d: str) -> DataFrame:
    """hand_log() with equities, written once."""
    return cut(R.replay(hand_log(spark, d)))


def met_open(spark: SparkSession, d: str) -> DataFrame:
    h = replayed(spark, d)
    return P.meetings(lined_up(h), P.population_rates(h), R.MORE_STEP, _SINCE | R.MORE_HAND)


@query()
def action_equity(spark: SparkSession, d: str) -> DataFrame:
    """Shares of every seat before and after every step, and the actor's strength: one row per step and seat."""
    h = replayed(spark, d)
    rows = h.select("hand_idx", "seats", F.explode("acts").alias("a")).select("hand_idx", "a", F.explode("seats").alias("s"))
    return rows.select("hand_idx", F.expr("a.k").alias("action_no"), F.expr("s.p").alias("player_idx"), F.expr("get(a.eq, s.i)").alias("eq_pre"), F.expr("get(a.eqp, s.i)").alias("eq_post"), F.expr("case when a.player_idx = s.p then a.hs end").alias("strength"))


@query()
def heads_up_equity(spark: SparkSession, d: str) -> DataFrame:
    """Share of a seat against one other alone, at the start of every street both came to."""
    h = replayed(spark, d).select("hand_idx", "seats", F.expr("size(seats)").alias("ns"), F.posexplode("hu").alias("street", "m"))
    rows = h.filter("m is not null").select("hand_idx", "street", "ns", "m", "seats", F.explode("seats").alias("x")).select("*", F.explode("seats").alias("y")).filter("x.p < y.p")
    return rows.select("hand_idx", "street", F.expr("x.p").alias("a"), F.expr("y.p").alias("b"), F.expr("get(m, x.i * ns + y.i)").alias("share")).filter("share is not null")


def engine(spark: SparkSession, d: str, then: Callable[[handarrays.Frame], handarrays.Frame] | None = None, schema: StructType | None = None) -> DataFrame:
    """The rows of pair_hand_engine(), or what `then` makes of them inside the tasks, of the schema."""
    hands, seats, steps = whole_hands(spark, d), table(spark, d, "seats"), table(spark, d, "actions").filter(is_step())
    h = handarrays.gathered(hands.select("hand_idx", "button_seat", "bb", "final_pot", "board"), seats, steps)
    return pairarrays.pairs(h, pairarrays.rates(hands, seats, steps), then, schema)


@query()
def pair_hand_engine(spark: SparkSession, d: str) -> DataFrame:
    """The pair-hand engine with equities: all features of pair_hand_features() and those of equity, strength, gifts and impact."""
    return engine(spark, d)


@query()
def pair_signatures_open(spark: SparkSession, d: str) -> DataFrame:
    """Rates, binomial z and asymmetries of all signature flags and sums, those of equity included."""
    marks = engine(spark, d, pairarrays.marks, pairarrays.MARKS)
    return P.signatures(*pairarrays.counted(marks), ["a", "b"], True)


@query()
def open_event_table(spark: SparkSession, d: str) -> DataFrame:
    """event_table() of the events that need equities or the strength of starting hands."""
    return E.event_counts(E.event_masks(met_open(spark, d), E.EQUITY_EVENTS), E.EQUITY_EVENTS)


@query()
def luck_free_impact(spark: SparkSession, d: str) -> DataFrame:
    """What each player's steps moved to each other seat's share of the pot, in big blinds; cards dealt count for nothing. A
    player's own share loses what others gain, so the impacts of a step add up to 0 over the seats."""
    h = replayed(spark, d).select("hand_idx", "bb", "seats", F.explode("acts").alias("a")).select("*", F.explode("seats").alias("s"))
    moved = "((coalesce(get(a.eqp, s.i), 0) - coalesce(get(a.eq, s.i), 0)) * a.pot_before + coalesce(get(a.eqp, s.i), 0) * a.amount - case when a.player_idx = s.p then a.amount else 0 end) / bb"
    rows = h.filter("exists(a.eq, e -> e is not null) and exists(seats, q -> q.p = a.player_idx) and a.amount is not null and a.pot_before is not null").select("hand_idx", F.expr("a.player_idx").alias("actor"), F.expr("s.p").alias("player_idx"), F.expr(moved).alias("v"))
    return rows.groupBy("hand_idx", "actor", "player_idx").agg(F.sum("v").alias("impact"))
