"""What two members of a group did to each other: one pass over an ordered log of hands, one row per hand and ordered pair.

The log comes to its hands in one exchange per table: copies are merged there, states are windows inside the hand, and a hand
becomes one row with the arrays of its seats and steps. Exploded again, a step of X meets every other seat Y of the hand, with
what Y had done by then; all features and events are aggregates of conditions over these rows. The conditions are catalogues
of expressions over the columns that meetings() names; a row without a step (s is true) stands for the hand as a whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.cards import class_169

AGGR = "(action IN (3, 4) OR (action = 5 AND coalesce(amount > to_call, false)))"
CALL = "(action = 2 OR (action = 5 AND coalesce(amount <= to_call, false)))"
STEP = ["street", "player_idx", "action", "amount", "to_call", "pot_before"]
SEAT = ["seat_no", "net_chips", "went_to_showdown", "total_contribution", "c1", "c2"]
#: Fixed values of the method: cells of the population's rates with fewer rows fall back to the coarse ones.
LEAST_CELL = 150


def by_hand(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per hand and key, each column from any copy that has it; in one exchange by hand, after copies collapsed."""
    known = df.filter(" and ".join(f"{k} is not null" for k in ["hand_idx", *keys]))
    sets = known.groupBy("hand_idx").agg(F.collect_set(F.struct(*keys, *columns)).alias("r"))
    rows = sets.select("hand_idx", F.explode("r").alias("r")).select("hand_idx", "r.*")
    return rows.groupBy("hand_idx", *keys).agg(*(F.max(c).alias(c) for c in columns))


def staged(steps: DataFrame) -> DataFrame:
    """Steps with the state before them: raises and calls, the last aggressor, who is in, and folds."""
    before = lambda *keys: Window.partitionBy("hand_idx", *keys).orderBy("action_no").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c, w: F.coalesce(F.sum(F.expr(f"cast({c} as int)")).over(w), F.lit(0))
    a = steps.withColumns({"aggr": F.expr(AGGR), "calls": F.expr(CALL), "isfold": F.expr("action = 0")})
    a = a.withColumn("enters", F.expr("street = 0 and (aggr or calls)"))
    a = a.withColumns(
        {
            "nr": count("aggr", before("street")),
            "l": F.last(F.expr("case when aggr then player_idx end"), ignorenulls=True).over(before("street")),
            "lall": F.coalesce(F.last(F.expr("case when aggr then action = 5 end"), ignorenulls=True).over(before("street")), F.lit(False)),
            "xagg": count("aggr", before("street", "player_idx")) > 0,
            "v1": F.expr("enters") & (count("enters", before("player_idx")) == 0),
            "nc": count("(calls and street = 0)", before()),
            "nf": count("isfold", before()),
        }
    )
    return a.withColumns({"nvol": count("v1", before()), "cao": count("(calls and street = 0 and nr > 0)", before())})


def staged_arrays(steps: DataFrame) -> DataFrame:
    """(hand_idx, acts): staged() steps as one array a hand, in order. A hand has few steps, so looking back inside the array costs
    less than a sort for every window."""
    raw = steps.withColumns({"aggr": F.expr(AGGR), "calls": F.expr(CALL), "isfold": F.expr("action = 0")})
    fields = ["player_idx", "street", "action", "amount", "to_call", "pot_before", "aggr", "calls", "isfold"]
    hands = raw.groupBy("hand_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("action_no").alias("k"), *fields))).alias("a0"))
    own = ", ".join(f"'{f}', m.a.{f}" for f in ["k", *fields])
    looked = """transform(a0, a -> named_struct('a', a, 'p', filter(a0, b -> b.k < a.k and b.street = a.street and b.aggr), 'q', filter(a0, b -> b.k < a.k and (b.isfold or b.street = 0))))"""
    first = f"""transform({looked}, m -> named_struct({own}, 'nr', size(m.p), 'l', get(m.p, size(m.p) - 1).player_idx, 'lall', coalesce(get(m.p, size(m.p) - 1).action = 5, false),
        'xagg', exists(m.p, b -> b.player_idx = m.a.player_idx), 'nc', size(filter(m.q, b -> b.calls and b.street = 0)), 'nf', size(filter(m.q, b -> b.isfold)),
        'v1', m.a.street = 0 and (m.a.aggr or m.a.calls) and not exists(m.q, b -> b.player_idx = m.a.player_idx and b.street = 0 and (b.aggr or b.calls))))"""
    names = ", ".join(f"'{f}', a.{f}" for f in ["k", *fields, "nr", "l", "lall", "xagg", "nc", "nf"])
    second = f"transform(a1, a -> named_struct({names}, 'nvol', size(filter(a1, b -> b.k < a.k and b.v1)), 'cao', size(filter(a1, b -> b.k < a.k and b.calls and b.street = 0 and b.nr > 0))))"
    return hands.withColumn("a1", F.expr(first)).select("hand_idx", F.expr(second).alias("acts"))


def hand_rows(hands: DataFrame, seats: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per hand that has seats: its fields, `seats` and `acts` in order, the `streets` played, and `sand`.

    Steps of players without a seat in the hand stay in acts but meet nobody.
    """
    acts = staged_arrays(by_hand(steps, ["action_no"], STEP))
    own = by_hand(seats, ["player_idx"], SEAT).withColumn("cls", class_169(F.col("c1"), F.col("c2")))
    own = own.groupBy("hand_idx").agg(F.array_sort(F.collect_list(F.struct("player_idx", *SEAT, "cls"))).alias("seats"))
    h = hands.join(own, "hand_idx").join(acts, "hand_idx", "left").withColumn("acts", F.expr("coalesce(acts, array())"))
    first = lambda c: f"array_min(transform(filter(acts, a -> a.player_idx = s.player_idx and {c}), a -> a.k))"
    seat = f"""named_struct('p', s.player_idx, 'pos', cast(pmod(s.seat_no - button_seat, 6) as int), 'net', s.net_chips, 'sd', coalesce(s.went_to_showdown, false),
        'con', s.total_contribution, 'seat_no', s.seat_no, 'c1', s.c1, 'c2', s.c2, 'cls', s.cls, 'first_no', {first("a.street = 0")}, 'fold_no', {first("a.isfold")},
        'vol_no', {first("a.street = 0 and (a.aggr or a.calls)")}, 'aggr_no', {first("a.aggr")}, 'pfr_no', {first("a.street = 0 and a.aggr")}, 'allin', exists(acts, a -> a.player_idx = s.player_idx and a.street = 0 and a.action = 5))"""
    h = h.withColumn("seats", F.expr(f"transform(seats, s -> {seat})"))
    at = lambda no: f"get(filter(acts, a -> a.k = s.{no}), 0)"
    more = f"""named_struct('p', s.p, 'i', i, 'pos', s.pos, 'net', s.net, 'sd', s.sd, 'con', s.con, 'seat_no', s.seat_no, 'c1', s.c1, 'c2', s.c2, 'cls', s.cls, 'first_no', s.first_no, 'fold_no', s.fold_no,
        'vol_no', s.vol_no, 'aggr_no', s.aggr_no, 'pfr_no', s.pfr_no, 'allin', s.allin, 'fold_st', {at("fold_no")}.street, 'first_act', {at("first_no")}.action, 'first_l', {at("first_no")}.l,
        'limp_no', case when {at("first_no")}.calls and {at("first_no")}.nr = 0 then s.first_no end)"""
    h = h.withColumn("seats", F.expr(f"transform(seats, (s, i) -> {more})"))
    streets = """transform(filter(sequence(0, 3), t -> exists(acts, a -> a.street = t)), t -> named_struct('t', t,
        'k', array_min(transform(filter(acts, a -> a.street = t), a -> a.k)), 'aggr', exists(acts, a -> a.street = t and a.aggr)))"""
    entered = "transform(filter(acts, a -> a.street = 0 and (a.aggr or a.calls)), a -> named_struct('k', a.k, 'p', a.player_idx, 'aggr', a.aggr))"
    h = h.withColumns({"streets": F.expr(streets), "pv": F.expr(entered)})
    # A member raises again before the flop after the other one raised, a third having come in between.
    sand = """array_distinct(filter(flatten(transform(pv, b -> transform(pv, a -> case when a.aggr and b.aggr and b.k < a.k and a.p <> b.p
        and not exists(pv, c -> c.aggr and c.k > b.k and c.k < a.k and (c.p = a.p or c.p = b.p))
        and exists(pv, z -> z.k > b.k and z.k < a.k and z.p <> a.p and z.p <> b.p) then struct(least(a.p, b.p) as a, greatest(a.p, b.p) as b) end))), s -> s is not null))"""
    opened = "array_min(transform(filter(pv, a -> a.aggr), a -> a.k))"
    return h.withColumns({"sand": F.expr(sand), "opened": F.expr(f"get(filter(acts, a -> a.k = {opened}), 0)")})


def population_rates(h: DataFrame) -> DataFrame:
    """(cls, nr, pos, nc, n, p_aggr, p_fold, p_call) of preflop steps: what players with such a hand do in such a place. Cells of
    fewer than LEAST_CELL rows have the rates of all places (pos, nc aside). At most 169 * 4 * 6 * 3 rows."""
    acts = h.select("seats", F.explode("acts").alias("a")).filter("a.street = 0")
    x = acts.withColumn("x", F.expr("get(filter(seats, s -> s.p = a.player_idx), 0)")).filter("x.cls is not null and x.pos is not null")
    x = x.selectExpr("x.cls as cls", "least(a.nr, 3) as nr", "x.pos as pos", "least(a.nc, 2) as nc", "a.aggr as aggr", "a.isfold as isfold", "a.calls as calls")
    fine = x.groupBy("cls", "nr", "pos", "nc").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("bigint")).alias(c) for c in ("aggr", "isfold", "calls")))
    w = Window.partitionBy("cls", "nr")
    use = lambda c: F.when(F.col("n") >= LEAST_CELL, F.col(c) / F.col("n")).otherwise(F.sum(c).over(w) / F.sum("n").over(w))
    return fine.select("cls", "nr", "pos", "nc", "n", use("aggr").alias("p_aggr"), use("isfold").alias("p_fold"), use("calls").alias("p_call"))


#: Columns of an act that meetings() hands on, by name; a sentinel row has nulls there.
_ACT = {"k": "k", "street": "street", "act": "action", "amount": "amount", "tc": "to_call", "pot": "pot_before", "aggr": "aggr", "calls": "calls", "isfold": "isfold", "nr": "nr", "l": "l", "lall": "lall", "xagg": "xagg", "nvol": "nvol", "cao": "cao"}


def meetings(h: DataFrame, rates: DataFrame, steps: dict[str, str] = {}, more: dict[str, str] = {}) -> DataFrame:
    """One row per step of X and other seat Y of the hand, and one per X and Y without a step (s is true).

    steps are further expressions over the hand, x, y and the act a; more are such of the rows without a step.
    """
    base = ["hand_idx", "table_idx", "hand_seq", "phase", "bb", "final_pot"]
    state = {
        "x": "x.p", "y": "y.p", "s": "false", "xpos": "x.pos", "ypos": "y.pos", "xcls": "x.cls", "nc": "a.nc", "nact": "size(seats) - a.nf",
        "first": "coalesce(a.k = x.first_no, false)", "ya": "coalesce(y.fold_no > a.k, true)", "yd": "coalesce(y.first_no < a.k, false)", "yv": "coalesce(y.vol_no < a.k, false)",
        "yl": "coalesce(y.limp_no < a.k, false)", "pfirst": "coalesce(a.k = x.pfr_no, false)", "opener": "opened.player_idx", "unopened": "coalesce(opened.nvol = 0, false)",
    }
    inside = lambda who: f"coalesce({who}.fold_no >= q.k, true)"
    met = f"{inside('x')} and {inside('y')}"
    left = "(size(seats) - size(filter(seats, w -> coalesce(w.fold_no < q.k, false))))"
    third = "b.isfold and b.l = x.p and b.player_idx <> x.p and b.player_idx <> y.p"
    whole = {
        "x": "x.p", "y": "y.p", "s": "true", "xnet": "coalesce(x.net, 0)", "ynet": "coalesce(y.net, 0)", "xsd": "x.sd", "ysd": "y.sd", "xcon": "coalesce(x.con, 0)", "xvol": "x.vol_no is not null", "yvol": "y.vol_no is not null", "xpfr": "x.pfr_no is not null",
        "xallin": "x.allin", "xfold_st": "coalesce(x.fold_st, 9)", "yfold_st": "coalesce(y.fold_st, 9)", "xfirst_act": "x.first_act", "xfirst_l": "x.first_l", "xpfr_no": "x.pfr_no", "xfold_no": "x.fold_no", "yaggr_no": "y.aggr_no", "yfirst_no": "y.first_no",
        "xpos": "x.pos", "ypos": "y.pos", "xseat": "x.seat_no", "yseat": "y.seat_no", "nb": "coalesce(size(filter(board, c -> c is not null)), 0)", "nvols": "nvols", "npre": "npre", "nleft": "nleft",
        "big3": "exists(seats, w -> w.p <> x.p and w.p <> y.p and coalesce(w.con, 0) >= 3 * bb)", "sandwich": "array_contains(sand, struct(least(x.p, y.p) as a, greatest(x.p, y.p) as b))",
        "both_st": f"size(filter(streets, q -> {met}))", "hu_st": f"size(filter(streets, q -> q.t > 0 and q.n = 2 and {met}))", "hu_still": f"size(filter(streets, q -> q.t > 0 and q.n = 2 and not q.aggr and {met}))",
        "mw_st": f"size(filter(streets, q -> q.t > 0 and q.n >= 3 and {met}))", "mw_still": f"size(filter(streets, q -> q.t > 0 and q.n >= 3 and not q.aggr and {met}))",
        "tf": f"size(filter(folds, b -> {third}))", "tf_pre": f"size(filter(folds, b -> {third} and b.street = 0))", "tf_act": f"size(filter(folds, b -> {third} and coalesce(y.fold_no > b.k, true)))",
    } | more
    counts = {"nvols": "size(filter(seats, w -> w.vol_no is not null))", "npre": "size(filter(acts, b -> b.street = 0))", "nleft": "size(filter(seats, w -> w.fold_no is null))", "folds": "filter(acts, b -> b.isfold and b.l is not null)"}
    hands = h.withColumns({**{c: F.expr(e) for c, e in counts.items()}, "streets": F.expr(f"transform(streets, q -> named_struct('t', q.t, 'k', q.k, 'aggr', q.aggr, 'n', {left}))")})
    at_step = {c: f"a.{f}" for c, f in _ACT.items()} | state | steps
    bound = {c: re.sub(r"\b([ax])\.", r"m.\1.", e) for c, e in at_step.items()}
    both = lambda over, fields: f"flatten(transform({over}, y -> named_struct({', '.join(f"'{c}', {e}" for c, e in fields.items())}))))"
    moves = "transform(filter(acts, a -> exists(seats, q -> q.p = a.player_idx)), a -> named_struct('a', a, 'x', get(filter(seats, q -> q.p = a.player_idx), 0)))"
    over = {"met": ("moves, m -> transform(filter(seats, y -> y.p <> m.x.p)", bound), "alone": ("seats, x -> transform(filter(seats, y -> y.p <> x.p)", whole)}
    hands = hands.withColumn("moves", F.expr(moves))
    typed = hands.select(*(F.expr(both(o, fields)).alias(c) for c, (o, fields) in over.items())).schema
    kinds = {f.name: f.dataType.simpleString() for c in over for f in typed[c].dataType.elementType.fields}
    every = (both(o, {n: f"cast({fields.get(n, 'null')} as {t})" for n, t in kinds.items()}) for o, fields in over.values())
    rows = hands.select(*base, F.explode(F.concat(*map(F.expr, every))).alias("z")).select(*base, "z.*")
    cell = {"cls": F.col("xcls"), "nr": F.least("nr", F.lit(3)), "pos": F.col("xpos"), "nc": F.least("nc", F.lit(2))}
    keyed = rows.withColumns({f"__{c}": F.when(F.col("street") == 0, e) for c, e in cell.items()})
    sided = rates.select(*(F.col(c).alias(f"__{c}") for c in cell), F.col("p_aggr").alias("pa"), F.col("p_fold").alias("pf"), F.col("p_call").alias("pc"))
    return keyed.join(F.broadcast(sided), [f"__{c}" for c in cell], "left").drop(*(f"__{c}" for c in cell))  # at most 12,168 rows


# Features of X towards Y. Each is an aggregate over the meetings of a hand, in SQL.

FACED = "l = y AND tc > 0"


def _count(c: str) -> str:
    return f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS INT)"


def _hand(e: str) -> str:
    return f"max(CASE WHEN s THEN {e} END)"


FEATURES = {
    "face": _count(FACED),
    **{f"{name}_{where}": _count(f"{FACED} AND {c} AND street {op} 0") for where, op in (("pre", "="), ("post", ">")) for name, c in (("fold", "isfold"), ("call", "calls"), ("raise", "aggr"))},
    "min_pfold_pre": f"coalesce(min(CASE WHEN {FACED} AND isfold AND street = 0 THEN coalesce(pf, 0.5) END), 1)",
    "min_pcall_pre": f"coalesce(min(CASE WHEN {FACED} AND calls AND street = 0 THEN coalesce(pc, 0.5) END), 1)",
    "aggpre": _count("aggr AND street = 0"),
    "minpa": "coalesce(min(CASE WHEN aggr AND street = 0 THEN coalesce(pa, 0.5) END), 1)",
    "trash": _count("aggr AND street = 0 AND pa < 0.02"),
    "weak10": _count("aggr AND street = 0 AND pa < 0.1"),
    "aggpost": _count("aggr AND street > 0 AND ya"),
    "vol": _hand("CAST(xvol AS INT)"),
    "enter": _hand("CAST(coalesce(xfirst_act <> 0, false) AS INT)"),
    "first_fold_nonfacing": _hand("CAST(coalesce(xfirst_act = 0, false) AND coalesce(xfirst_l <> y, true) AS INT)"),
    "fold_after_aggr": _hand("CAST(coalesce(xfold_no > yaggr_no, false) AS INT)"),
    "net_bb": _hand("CAST(xnet AS DOUBLE) / bb"),
    "tf": _hand("tf"), "tf_pre": _hand("tf_pre"), "tf_act": _hand("tf_act"),
    "pfr_no": _hand("xpfr_no"),
    "pfr_p": "max(CASE WHEN pfirst THEN coalesce(pa, 0.5) END)",
    "pfr_behind": _hand("CASE WHEN coalesce(yfirst_no > xpfr_no, true) THEN 1 ELSE 0 END"),
    "pfr_ord": _hand("(xpos + 3) % 6"),
}
#: What a hand and pair have in common, the same from both sides.
COMMON = {
    "pot_bb": _hand("CAST(final_pot AS DOUBLE) / bb"), "board_n": _hand("nb"), "players_vol": _hand("nvols"), "pre_actions": _hand("npre"), "both_streets": _hand("both_st"), "hu_streets": _hand("hu_st"),
    "hu_checked_streets": _hand("hu_still"), "sd_both": _hand("CAST(xsd AND ysd AS INT)"), "hu_final": _hand("CAST(nleft = 2 AND xfold_st = 9 AND yfold_st = 9 AS INT)"), "sandwich": _hand("CAST(sandwich AS INT)"),
}
#: The same with equities of the steps and the pair, see replay() in tarn.operators.replay.
EQUITY = {
    "max_pfeq_call_pre": f"coalesce(max(CASE WHEN {FACED} AND calls AND street = 0 THEN xeq1 END), -1)",
    "max_hueq_fold_post": f"coalesce(max(CASE WHEN {FACED} AND isfold AND street > 0 THEN he END), -1)",
    "min_hueq_call_post": f"coalesce(min(CASE WHEN {FACED} AND calls AND street > 0 THEN he END), 2)",
    "min_hueq_call_tr": f"coalesce(min(CASE WHEN {FACED} AND calls AND street >= 2 THEN he END), 2)",
    "max_hs_fold_post": f"coalesce(max(CASE WHEN {FACED} AND isfold AND street > 0 THEN hs END), -1)",
    "max_hs_call_post": f"coalesce(max(CASE WHEN {FACED} AND calls AND street > 0 THEN hs END), -1)",
    "max_eq_fold_face": f"coalesce(max(CASE WHEN {FACED} AND isfold THEN coalesce(eqx, 0) END), -1)",
    "strongcheck": _count("act = 1 AND street > 0 AND ya AND hs >= 0.8"),
    "max_hs_check": "coalesce(max(CASE WHEN act = 1 AND street > 0 AND ya THEN hs END), -1)",
    "bluffinto": _count("answered AND he <= 0.3"),
    "gift": "coalesce(sum(gift), 0)",
    "gift_max": "coalesce(max(gift), 0)",
    "imp": "coalesce(sum(imp), 0)",
}


def directed(meetings: DataFrame, equity: bool = False) -> DataFrame:
    """(hand_idx, x, y, features): one row per hand and ordered pair of its seats."""
    wanted = FEATURES | COMMON | (EQUITY if equity else {})
    return meetings.groupBy("hand_idx", "x", "y").agg(*(F.expr(e).alias(c) for c, e in wanted.items()))


#: Features of an unordered pair a < b out of both directions; x is a's row, y is b's.
PAIRED = {
    "third_vol": "x.players_vol - x.vol - y.vol", "tf_facing": "x.tf + y.tf", "tf_pre": "x.tf_pre + y.tf_pre", "tf_both_active": "x.tf_act + y.tf_act",
    "fpa_role": "CASE WHEN x.pfr_no IS NULL AND y.pfr_no IS NULL THEN 0 WHEN coalesce(x.pfr_no, 99999) < coalesce(y.pfr_no, 99999) THEN 1 ELSE 2 END",
    **{f"fpa_{c}": f"CASE WHEN x.pfr_no IS NULL AND y.pfr_no IS NULL THEN {none} WHEN coalesce(x.pfr_no, 99999) < coalesce(y.pfr_no, 99999) THEN x.pfr_{f} ELSE y.pfr_{f} END" for c, f, none in (("ord", "ord", 9), ("p", "p", 1), ("partner_behind", "behind", 0))},
}
_INNER = {"tf", "tf_pre", "tf_act", "pfr_no", "pfr_p", "pfr_behind", "pfr_ord"}


def paired_columns(equity: bool = False) -> dict[str, str]:
    """Columns of a pair's row and their expressions over x and y."""
    own = {c: f"{s}.{c}" for s in "x" for c in COMMON} | PAIRED
    for c in [c for c in FEATURES if c not in _INNER] + (list(EQUITY) if equity else []):
        own |= {f"{c}_ab": f"x.{c}", f"{c}_ba": f"y.{c}"}
    return own


def pairs(directed_rows: DataFrame, equity: bool = False) -> DataFrame:
    """(hand_idx, a, b, features): the two directions of every pair side by side, gathered inside the hand."""
    values = [c for c in directed_rows.columns if c not in ("hand_idx", "x", "y")]
    sides = F.struct(F.col("x").alias("p"), *values)
    both = directed_rows.groupBy("hand_idx", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.array_sort(F.collect_list(sides)).alias("v"))
    both = both.filter("size(v) = 2").select("hand_idx", "a", "b", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return both.select("hand_idx", "a", "b", *(F.expr(e).alias(c) for c, e in paired_columns(equity).items()))


# Signature flags of a pair-hand. Directional ones are written for d = ab or ba, o being the other.

_RAISEBACK = "(raise_pre_ab + raise_post_ab + raise_pre_ba + raise_post_ba > 0)"
_TRASH = "(trash_ab + trash_ba > 0)"
_FOLD_AFTER = "(fold_after_aggr_ab = 1 OR fold_after_aggr_ba = 1)"
_PLAIN = f"(enter_ab = 1 AND enter_ba = 1 AND face_ab + face_ba > 0 AND NOT {_RAISEBACK})"
_STRONG = "(strongcheck_ab + strongcheck_ba > 0)"
_FOLDPOST = "(fold_post_ab + fold_post_ba > 0)"
_CALL80 = "(greatest(max_hs_call_post_ab, max_hs_call_post_ba) >= 0.8)"
_CALLPRE55 = "((call_pre_ab > 0 AND max_pfeq_call_pre_ab >= 0.55) OR (call_pre_ba > 0 AND max_pfeq_call_pre_ba >= 0.55))"
_FLOW = "(net_bb_{d} < 0 AND net_bb_{o} > 0)"
SYMMETRIC = {
    "both_vol": "vol_ab = 1 AND vol_ba = 1", "both_flop": "both_streets >= 2", "sd_both": "sd_both = 1", "hu_final": "hu_final = 1", "sp_g0": "NOT (first_fold_nonfacing_ab = 1 OR first_fold_nonfacing_ba = 1)",
    "sp_g1": "enter_ab = 1 AND enter_ba = 1", "sp_pl": _PLAIN, "sp_hu_checked": "hu_checked_streets > 0", "sp_raiseback": _RAISEBACK, "ci_trash": _TRASH, "ci_weak10": "weak10_ab + weak10_ba > 0",
    "ci_s14": "fpa_ord = 0 AND fpa_p < 0.3", "ci_s7": f"{_TRASH} AND ({_FOLD_AFTER} OR {_RAISEBACK})", "ci_s10": f"{_TRASH} AND tf_pre >= 3",
    "ci_s16": f"fpa_ord <= 2 AND fpa_partner_behind = 1 AND ({_FOLD_AFTER} OR {_RAISEBACK}) AND fpa_p < 0.3", "ci_sandwich": "sandwich = 1", "ci_tf3": "tf_both_active >= 3",
}
SYMMETRIC_EQUITY = {
    "sp_strongcheck": _STRONG, "sp_foldpost_hs60": f"{_FOLDPOST} AND greatest(max_hs_fold_post_ab, max_hs_fold_post_ba) >= 0.6", "sp_callpost_hs80": _CALL80, "sp_callpre_eq55": _CALLPRE55,
    "sp_u1": f"{_STRONG} OR {_FOLDPOST} OR {_CALL80}", "sp_pl_soft": f"{_PLAIN} AND ({_STRONG} OR {_FOLDPOST} OR {_CALL80} OR {_CALLPRE55})",
}
DIRECTIONAL = {
    "dt_flow": _FLOW, "dt_pcall15": "min_pcall_pre_{d} <= 0.15", "dt_pcall05": "min_pcall_pre_{d} <= 0.05", "dt_callpre": "call_pre_{d} > 0", "dt_raisepre": "raise_pre_{d} > 0", "x_trash": "trash_{d} > 0",
    "x_face": "face_{d} > 0", "x_foldface": "fold_pre_{d} + fold_post_{d} > 0",
}
DIRECTIONAL_EQUITY = {
    "dt_strong": f"{_FLOW} AND (max_hueq_fold_post_{{d}} >= 0.7 OR min_hueq_call_tr_{{d}} <= 0.15)",
    "dt_union": f"{_FLOW} AND (max_hueq_fold_post_{{d}} >= 0.5 OR min_hueq_call_post_{{d}} <= 0.25 OR bluffinto_{{d}} > 0 OR (fold_pre_{{d}} > 0 AND max_eq_fold_face_{{d}} >= 0.5))",
    "dt_gift5": f"{_FLOW} AND gift_{{d}} > 5", "dt_bluffinto": "bluffinto_{d} > 0", "x_strongcheck": "strongcheck_{d} > 0",
}
SUMS = {"transfer": f"CASE WHEN {_FLOW} THEN least(-net_bb_{{d}}, net_bb_{{o}}) ELSE 0 END"}
SUMS_EQUITY = {"gift": "gift_{d}", "imp": "imp_{d}"}


def flags(equity: bool = False) -> dict[str, str]:
    """All flags by name; directional ones for both directions."""
    both = DIRECTIONAL | (DIRECTIONAL_EQUITY if equity else {})
    sides = {f"{k}_{d}": e.format(d=d, o=o) for k, e in both.items() for d, o in (("ab", "ba"), ("ba", "ab"))}
    return SYMMETRIC | (SYMMETRIC_EQUITY if equity else {}) | sides


def sums(equity: bool = False) -> dict[str, str]:
    return {f"{k}_{d}": e.format(d=d, o=o) for k, e in (SUMS | (SUMS_EQUITY if equity else {})).items() for d, o in (("ab", "ba"), ("ba", "ab"))}


def pair_signatures(rows: DataFrame, keys: list[str], equity: bool = False) -> DataFrame:
    """One row per pair: of symmetric flags the rate and binomial z against all rows, of directional ones the greater and lesser
    rate and z and the asymmetry, of sums the greater and lesser mean and the asymmetry."""
    f, t = flags(equity), sums(equity)
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *(F.expr(f"sum(CASE WHEN {e} THEN 1 ELSE 0 END)").alias(f"c_{k}") for k, e in f.items()), *(F.expr(f"sum({e})").alias(f"s_{k}") for k, e in t.items())
    )
    return signatures(counts, counts, keys, equity)


def signatures(counts: DataFrame, parts: DataFrame, keys: list[str], equity: bool = False) -> DataFrame:
    """pair_signatures() of the counts of flags (c_), the sums (s_) and the rows (n) of every pair; parts have the counts of all rows."""
    base = parts.agg(*((F.sum(f"c_{k}") / F.sum("n")).alias(f"p_{k}") for k in flags(equity)))
    return counts.crossJoin(F.broadcast(base)).select(*keys, "n", *(F.expr(e).alias(c) for c, e in signature_columns(equity).items()))  # one row


def signature_columns(equity: bool = False) -> dict[str, str]:
    """The measures of pair_signatures() over counts c_, sums s_ and base rates p_."""
    z = lambda c, p: f"({c} - n * {p}) / sqrt(n * {p} * (1 - {p}) + 1e-9)"
    out = {"log_n": "ln(n)"}
    for k in SYMMETRIC | (SYMMETRIC_EQUITY if equity else {}):
        out |= {f"r_{k}": f"c_{k} / CAST(n AS DOUBLE)", f"z_{k}": z(f"c_{k}", f"p_{k}")}
    for k in DIRECTIONAL | (DIRECTIONAL_EQUITY if equity else {}):
        x, y, p = f"c_{k}_ab", f"c_{k}_ba", f"(0.5 * (p_{k}_ab + p_{k}_ba))"
        out |= {f"r_{k}_{m}": f"{e}({x}, {y}) / CAST(n AS DOUBLE)" for m, e in (("max", "greatest"), ("min", "least"))}
        out |= {f"z_{k}_{m}": z(f"{e}({x}, {y})", p) for m, e in (("max", "greatest"), ("min", "least"))} | {f"r_{k}_asym": f"abs({x} - {y}) / CAST(n AS DOUBLE)"}
    for k in SUMS | (SUMS_EQUITY if equity else {}):
        x, y = f"s_{k}_ab", f"s_{k}_ba"
        out |= {f"m_{k}_max": f"greatest({x}, {y}) / n", f"m_{k}_min": f"least({x}, {y}) / n", f"m_{k}_asym": f"abs({x} - {y}) / n"}
    return out
