"""The pair-hand engine on flat arrays: many hands at once, each column an array over all their steps, seats or pairs.

The conditions are the same SQL expressions that pairhand.meetings() serves, here evaluated on numpy arrays with SQL's nulls.
Hands come as gathered() makes them; copies are merged here. Within a batch hands, seats and steps are sorted, so a step's place
in the array orders it within its hand as its number does.
"""

from __future__ import annotations

import functools
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.pairhand import SEAT, STEP

_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_INVERSE = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


@functools.cache
def parse(sql: str) -> tuple:
    """Syntax tree of a condition or value: AND, OR, NOT, comparisons, IN, BETWEEN, IS NULL, arithmetic, CASE, CAST to int or
    double, coalesce, greatest, least, names and numbers."""
    tokens = re.findall(r"\d+\.\d+|\d+|\w+|<>|<=|>=|[-+*/%<>=(),]", sql)
    at = 0

    def peek() -> str:
        return tokens[at].upper() if at < len(tokens) else ""

    def take(*wanted: str) -> str:
        nonlocal at
        if wanted and peek() not in wanted:
            raise ValueError(f"{wanted} expected at token {at} of {sql}")
        at += 1
        return tokens[at - 1]

    def chain(deeper, kinds: dict) -> tuple:
        left = deeper()
        while peek() in kinds:
            left = (kinds[take().upper()], left, deeper())
        return left

    def either() -> tuple:
        return chain(both, {"OR": "or"})

    def both() -> tuple:
        return chain(negated, {"AND": "and"})

    def negated() -> tuple:
        if peek() == "NOT":
            take()
            return ("not", negated())
        return compared()

    def compared() -> tuple:
        left = added()
        if peek() in _COMPARE:
            return ("compare", take(), left, added())
        if peek() == "IN":
            take()
            take("(")
            out = ("compare", "=", left, added())
            while take(",", ")") == ",":
                out = ("or", out, ("compare", "=", left, added()))
            return out
        if peek() == "BETWEEN":
            take()
            low = added()
            take("AND")
            return ("and", ("compare", ">=", left, low), ("compare", "<=", left, added()))
        if peek() == "IS":
            take()
            known = peek() == "NOT" and bool(take())
            take("NULL")
            return ("not", ("null", left)) if known else ("null", left)
        return left

    def added() -> tuple:
        return chain(multiplied, {"+": "+", "-": "-"})

    def multiplied() -> tuple:
        return chain(single, {"*": "*", "/": "/", "%": "%"})

    def single() -> tuple:
        token = take()
        if token == "(":
            inner = either()
            take(")")
            return inner
        if token == "-":
            return ("*", ("number", -1, 0), single())
        if token.upper() == "CASE":
            cases = []
            while take("WHEN", "ELSE", "END").upper() == "WHEN":
                when = either()
                take("THEN")
                cases.append((when, either()))
            other = None
            if tokens[at - 1].upper() == "ELSE":
                other = either()
                take("END")
            return ("case", tuple(cases), other)
        if token.upper() == "CAST":
            take("(")
            inner = either()
            take("AS")
            kind = take("INT", "DOUBLE").upper()
            take(")")
            return ("cast", kind, inner)
        if token.lower() in ("coalesce", "greatest", "least"):
            take("(")
            over = [either()]
            while take(",", ")") == ",":
                over.append(either())
            return (token.lower(), *over)
        if token[0].isdigit():
            return ("number", int(token.replace(".", "")), len(token.partition(".")[2]))
        return ("truth", token.lower() == "true") if token.lower() in ("true", "false") else ("column", token)

    tree = either()
    if at < len(tokens):
        raise ValueError(f"{tokens[at:]} left over in {sql}")
    return tree


class Frame:
    """Columns by name, each an array of values and one of which are filled (True if all are); a name that is not there is null.

    holds() says where a condition is true. Decimal numbers are whole numbers and a scale, so they compare exactly with whole
    numbers, as in SQL.
    """

    def __init__(self, columns: dict, size: int):
        self.columns, self.size, self.kept = columns, size, {}

    def holds(self, sql: str):
        return self.logic(parse(sql), True)

    def logic(self, node: tuple, wanted: bool):
        """Where the node is true, or where it is false: an array, or one bool for all."""
        key = (node, wanted)
        if key not in self.kept:
            self.kept[key] = self._logic(node, wanted)
        return self.kept[key]

    def _logic(self, node: tuple, wanted: bool):
        kind = node[0]
        if kind == "null":
            filled = self.known(node[1])
            return np.logical_not(filled) if isinstance(filled, np.ndarray) and wanted else filled if isinstance(filled, np.ndarray) else filled is not wanted
        if kind == "coalesce":  # of a condition and true or false
            if node[2] != ("truth", wanted):
                return self.logic(node[1], wanted)
            found = self.logic(node[1], not wanted)
            return ~found if isinstance(found, np.ndarray) else not found
        if kind == "truth":
            return node[1] == wanted
        if kind == "not":
            return self.logic(node[1], not wanted)
        if kind in ("and", "or"):
            together = (kind == "and") == wanted
            first = self.logic(node[1], wanted)
            if first is (not together):
                return first
            second = self.logic(node[2], wanted)
            if isinstance(first, bool):
                return second
            if isinstance(second, bool):
                return first if second is together else second
            return first & second if together else first | second
        if kind == "column":
            value, filled = self.columns.get(node[1], (None, False))
            if filled is False or isinstance(value, bool):
                return filled and value == wanted
            found = value if wanted else ~value
            return found if filled is True else found & filled
        sign = node[1] if wanted else _INVERSE[node[1]]
        (v, f, s), (w, g, t) = self.number(node[2]), self.number(node[3])
        if f is False or g is False:
            return False
        if s != t:
            real = any(np.asarray(a).dtype.kind == "f" for a in (v, w))
            v, w = (v / 10**s, w / 10**t) if real else (v * 10 ** max(t - s, 0), w * 10 ** max(s - t, 0))
        found = _COMPARE[sign](v, w)
        for filled in (f, g):
            found = found if filled is True else found & filled
        return found

    def number(self, node: tuple) -> tuple:
        """(value, filled, scale)"""
        if node[0] == "column":
            return (*self.columns.get(node[1], (None, False)), 0)
        if node[0] == "number":
            return node[1], True, node[2]
        if node[0] in ("case", "cast", "coalesce", "greatest", "least"):
            return self.built(node)
        (v, f, s), (w, g, t) = self.number(node[1]), self.number(node[2])
        if f is False or g is False:
            return None, False, 0
        if node[0] == "/":
            if np.any((np.asarray(w) == 0) & f & g):
                raise ZeroDivisionError(f"{node} divides by zero")
            return np.where(f if g is True else g if f is True else f & g, v / 10**s, 0.0) / np.where(g, w / 10**t, 1.0), f if g is True else g if f is True else f & g, 0
        wide = lambda a: a.astype(np.int64) if isinstance(a, np.ndarray) and a.dtype.kind == "i" else a
        v, w, filled = wide(v), wide(w), f if g is True else g if f is True else f & g
        if node[0] == "*":
            return v * w, filled, s + t
        v, w = v * 10 ** max(t - s, 0), w * 10 ** max(s - t, 0)
        return {"+": np.add, "-": np.subtract, "%": np.fmod}[node[0]](v, w), filled, max(s, t)

    def conditional(self, node: tuple) -> bool:
        """Whether the node is a condition, not a number."""
        if node[0] == "column":
            return np.asarray(self.columns.get(node[1], (0, True))[0]).dtype == bool
        return node[0] in ("and", "or", "not", "compare", "null", "truth") or (node[0] == "coalesce" and self.conditional(node[1]))

    def known(self, node: tuple):
        """Where the node is not null."""
        if not self.conditional(node):
            return self.number(node)[1]
        true, false = self.logic(node, True), self.logic(node, False)
        return True if true is True or false is True else true | false

    def value(self, sql: str) -> tuple[np.ndarray, np.ndarray | bool]:
        """Numbers that an expression has, and where there are some."""
        v, filled, s = self.number(parse(sql))
        v = np.zeros(self.size) if v is None else v / 10**s if s else v
        return np.broadcast_to(np.asarray(v), self.size), filled if isinstance(filled, bool) else np.broadcast_to(filled, self.size)

    def real(self, node: tuple) -> tuple[np.ndarray, np.ndarray]:
        """number() as arrays, without a scale."""
        v, filled, s = self.number(node)
        return np.asarray(0 if v is None else v / 10**s if s else v), np.asarray(filled)

    def built(self, node: tuple) -> tuple:
        """Numbers of CASE, CAST, coalesce, greatest and least, the last two without regard to nulls."""
        if node[0] == "cast" and self.conditional(node[2]):
            return np.asarray(self.logic(node[2], True)).astype(np.int32), self.known(node[2]), 0
        if node[0] == "cast":
            v, filled, s = self.number(node[2])
            v = None if v is None else v / 10**s if s else v
            return (None if v is None else np.asarray(v).astype(np.float64) if node[1] == "DOUBLE" else np.trunc(v).astype(np.int32)), filled, 0
        if node[0] == "case":
            out, filled = self.real(node[2]) if node[2] else (np.asarray(0), np.asarray(False))
            for when, then in reversed(node[1]):
                at, (v, f) = np.asarray(self.logic(when, True)), self.real(then)
                out, filled = np.where(at, v, out), np.where(at, f, filled)
            return out, filled, 0
        out, filled = self.real(node[1])
        for other in node[2:]:
            v, f = self.real(other)
            better = ~filled if node[0] == "coalesce" else f & (~filled | (v > out if node[0] == "greatest" else v < out))
            out, filled = np.where(better, v, out), filled | f
        return out, filled, 0


def gathered(hands: DataFrame, seats: DataFrame, steps: DataFrame, seat: list[str] = SEAT, step: list[str] = STEP) -> DataFrame:
    """Hands that have seats, with sets of their seats and steps as the log has them, or of some fields of these; in one exchange
    per table."""
    sets = lambda df, key, columns, name: df.filter(f"hand_idx is not null and {key} is not null").groupBy("hand_idx").agg(F.collect_set(F.struct(key, *columns)).alias(name))
    return hands.join(sets(seats, "player_idx", seat, "seats"), "hand_idx").join(sets(steps, "action_no", step, "acts"), "hand_idx", "left")


def plain(column) -> tuple[np.ndarray, np.ndarray | bool]:
    """Values of an Arrow column and which are filled; nulls are 0 or false."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False), True
    filled = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False), filled


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every one of counts[i] places of i: i and the place."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _lists(column, key: str) -> dict:
    """Fields of an array of structs over all hands, one row per hand and key in their order, each value from any copy that has it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.diff(column.offsets.to_numpy()) * (1 if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False))
    hand, inside = np.repeat(np.arange(len(counts)), counts), column.flatten()
    fields = {f.name: plain(inside.field(i)) for i, f in enumerate(inside.type)}
    code = (hand << 33) + fields[key][0].astype(np.int64) + (1 << 32)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1)) if len(order) else order
    out = {"hand": (hand[order][first], True)}
    for name, (value, filled) in fields.items():
        value, filled = value[order], True if filled is True else filled[order]
        if len(first) < len(order):
            low = np.where(filled, value.astype(np.int64), np.iinfo(np.int64).min) if filled is not True else value.astype(np.int64)
            best = np.maximum.reduceat(low, first)
            filled = True if filled is True else best > np.iinfo(np.int64).min
            value = np.where(filled, best, 0).astype(value.dtype)
        out[name] = (value, filled)
    return out


def _before(flag: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """How many earlier rows with the same keys have the flag."""
    group = functools.reduce(lambda c, k: c * (int(k.max(initial=0)) + 1) + k, keys[1:], keys[0].astype(np.int64))
    order = np.argsort(group, kind="stable")
    run = np.cumsum(flag[order]) - flag[order]
    starts = np.diff(group[order], prepend=-1) != 0
    out = np.empty(len(flag), np.int32)
    out[order] = run - run[np.maximum.accumulate(np.where(starts, np.arange(len(flag)), 0))] if len(flag) else run
    return out


class Hands:
    """A batch of gathered() hands: seats (s), steps (a), and the pairs of seats, a hand's in rows of n * n with the diagonal."""

    def __init__(self, batch: pa.Table):
        self.h = {c: plain(batch.column(c)) for c in batch.column_names if c not in ("seats", "acts", "board")}
        self.size = batch.num_rows
        self.s, self.a = _lists(batch.column("seats"), "player_idx"), _lists(batch.column("acts"), "action_no")
        board = batch.column("board").combine_chunks()
        cards = board.flatten()
        held = np.diff(board.offsets.to_numpy()) * (1 if not board.null_count else board.is_valid().to_numpy(zero_copy_only=False))
        self.nb = np.bincount(np.repeat(np.arange(self.size), held), cards.is_valid().to_numpy(zero_copy_only=False), self.size).astype(np.int32)
        self._steps()
        self._seats()

    def _steps(self) -> None:
        value = {c: v for c, (v, _) in self.a.items()}
        hand, street, action, player = value["hand"], value["street"].astype(np.int64), value["action"], value["player_idx"]
        filled = lambda *c: functools.reduce(operator.and_, (self.a[x][1] for x in c), True)
        known, n = filled("amount", "to_call"), len(hand)
        at = np.arange(n)
        aggr = (action == 3) | (action == 4) | ((action == 5) & (value["amount"] > value["to_call"]) & known)
        calls = (action == 2) | ((action == 5) & (value["amount"] <= value["to_call"]) & known)
        fold, preflop = action == 0, street == 0
        code = (hand << 33) + player.astype(np.int64) + (1 << 32)
        who = np.unique(code, return_inverse=True)[1].reshape(-1) if n else at  # a number of hand and player
        nr = _before(aggr, hand, street)
        # The last raise of the street before the step: the greatest place of one so far, in order of hand and street.
        order = np.argsort(hand * 4 + street, kind="stable")
        last = np.maximum.accumulate(np.where(aggr[order], np.arange(n), -1)) if n else order
        earlier = np.empty(n, np.int64)
        earlier[order] = np.concatenate([[-1], last[:-1]])[:n]
        raiser = np.where(nr > 0, order[earlier] if n else 0, 0)
        enters = preflop & (aggr | calls)
        v1 = enters & (_before(enters, who) == 0)
        self.a |= {
            "aggr": (aggr, True), "calls": (calls, True), "isfold": (fold, True), "nr": (nr, True), "l": (player[raiser] if n else player, nr > 0), "lall": ((action[raiser] == 5) & (nr > 0) if n else fold, True),
            "xagg": (_before(aggr, who, street) > 0, True), "nc": (_before(calls & preflop, hand), True), "nf": (_before(fold, hand), True), "nvol": (_before(v1, hand), True), "cao": (_before(calls & preflop & (nr > 0), hand), True),
        }
        self.enters, self.raiser, self.acode = enters, raiser, code

    def _seats(self) -> None:
        hand, player = self.s["hand"][0], self.s["player_idx"][0]
        self.n = np.bincount(hand, minlength=self.size)
        self.off = np.cumsum(self.n) - self.n
        self.place = np.arange(len(hand)) - self.off[hand]
        code = (hand << 33) + player.astype(np.int64) + (1 << 32)
        found = np.minimum(np.searchsorted(code, self.acode), max(len(code) - 1, 0))
        self.actor = np.where(code[found] == self.acode, found, -1) if len(code) else np.full(len(self.acode), -1)
        a = {c: self.a[c][0] for c in ("hand", "street", "action", "aggr", "calls", "isfold", "nr")}
        self.none = none = len(self.actor)  # the place of a step that is not there
        preflop, at = a["street"] == 0, np.arange(none)

        def first(flag: np.ndarray) -> np.ndarray:
            out, flag = np.full(len(hand), none, np.int64), flag & (self.actor >= 0)
            who = self.actor[flag][::-1]
            out[who] = at[flag][::-1]  # the last to be written is the earliest
            return out

        self.first, self.fold, self.vol, self.aggr, self.pfr = first(preflop), first(a["isfold"]), first(self.enters), first(a["aggr"]), first(preflop & a["aggr"])
        self.allin = first(preflop & (a["action"] == 5)) < none
        pick = lambda c, i: np.append(a[c], a[c].dtype.type(0))[i]
        self.limp = np.where((self.first < none) & pick("calls", self.first) & (pick("nr", self.first) == 0), self.first, none)
        self.fold_st = np.where(self.fold < none, pick("street", self.fold), 9)
        button, known = self.h["button_seat"]
        seat, there = self.s["seat_no"]
        self.pos = (np.mod(seat.astype(np.int64) - button.astype(np.int64)[hand], 6), np.broadcast_to(np.asarray(there), hand.shape) & np.broadcast_to(np.asarray(known), self.n.shape)[hand])
        opened = np.full(self.size, none, np.int64)
        raises = np.flatnonzero(preflop & a["aggr"])[::-1]
        opened[a["hand"][raises]] = raises
        self.opened = opened
        # By hand and street: the first step, whether anyone raised, and how many had not folded before it.
        slot = a["hand"] * 4 + a["street"]
        start = np.full(self.size * 4, none, np.int64)
        start[slot[::-1]] = at[::-1]
        self.start, self.raised = start, np.bincount(slot, a["aggr"], self.size * 4) > 0
        gone = [np.bincount(hand, self.fold < start.reshape(-1, 4)[hand, t], self.size) for t in range(4)]
        self.left = (self.n[:, None] - np.stack(gone, 1)).astype(np.int32)
        self.pairs = self.n**2
        self.pair_off = np.cumsum(self.pairs) - self.pairs

    def whole(self) -> Frame:
        """One row per pair, x and y being seats of one hand (also the same): columns of meetings() without a step."""
        h, inside = spread(self.pairs)
        n = self.n[h]
        xi, yi = np.divmod(inside, n)
        x, y = self.off[h] + xi, self.off[h] + yi
        net, con, sd = self._filled("net_chips"), self._filled("total_contribution"), self._filled("went_to_showdown")
        bb = self.h["bb"][0].astype(np.int64)
        big = con >= 3 * bb[self.s["hand"][0]]
        many = np.bincount(self.s["hand"][0], big, self.size)[h] - big[x] - np.where(x == y, 0, big[y])
        player = self.s["player_idx"][0]
        counts = {c: np.zeros(len(h), np.int32) for c in ("both_st", "hu_st", "hu_still", "mw_st", "mw_still")}
        for t in range(4):
            k = self.start.reshape(-1, 4)[h, t]
            met, still = (k < self.none) & (self.fold[x] >= k) & (self.fold[y] >= k), ~self.raised.reshape(-1, 4)[h, t]
            counts["both_st"] += met
            for name, some in (("hu", self.left[h, t] == 2), ("mw", self.left[h, t] >= 3)) if t else ():
                counts[f"{name}_st"] += met & some
                counts[f"{name}_still"] += met & some & still
        folds = self._third_folds(len(h))
        seat, there = self.s["seat_no"]
        of = lambda c, i: (c[0][i], c[1] if c[1] is True else c[1][i])
        sure = lambda v: (v, True)
        columns = {
            "s": (True, True), "x": sure(player[x]), "y": sure(player[y]), "bb": sure(bb[h]), "xnet": sure(net[x]), "ynet": sure(net[y]), "xsd": sure(sd[x]), "ysd": sure(sd[y]), "xcon": sure(con[x]),
            "xvol": sure(self.vol[x] < self.none), "yvol": sure(self.vol[y] < self.none), "xpfr": sure(self.pfr[x] < self.none), "xallin": sure(self.allin[x]), "xfold_st": sure(self.fold_st[x]), "yfold_st": sure(self.fold_st[y]),
            "xpos": of(self.pos, x), "ypos": of(self.pos, y), "xseat": of((seat, there), x), "yseat": of((seat, there), y), "nb": sure(self.nb[h]), "big3": sure(many > 0), **{c: sure(v) for c, v in (counts | folds).items()},
        }
        self.pair_hand, self.pair_x, self.pair_y = h, x, y
        return Frame(columns, len(h))

    def _filled(self, name: str) -> np.ndarray:
        return self.s[name][0] if self.s[name][0].dtype == bool else self.s[name][0].astype(np.int64)

    def _others(self, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(step, y, pair): steps with every seat y of their hand but `first`, the seat that is x."""
        h = self.a["hand"][0][steps]
        i, j = spread(self.n[h])
        y = self.off[h][i] + j
        other = y != first[i]
        i, y = i[other], y[other]
        return steps[i], y, self.pair_off[h][i] + self.place[first[i]] * self.n[h][i] + self.place[y]

    def _third_folds(self, size: int) -> dict:
        """How often a third one folded to x, and how often while y was in."""
        player, (l, known) = self.a["player_idx"][0], self.a["l"]
        steps = np.flatnonzero(self.a["isfold"][0] & known & (l != player)) if len(player) else np.arange(0)
        x = self.actor[self.raiser[steps]] if len(steps) else steps
        steps, x = steps[x >= 0], x[x >= 0]
        step, y, pair = self._others(steps, x)
        third = self.s["player_idx"][0][y] != player[step]
        step, y, pair = step[third], y[third], pair[third]
        count = lambda where: np.bincount(pair[where], minlength=size).astype(np.int32)
        return {"tf": count(slice(None)), "tf_pre": count(self.a["street"][0][step] == 0), "tf_act": count(self.fold[y] > step)}

    def steps(self) -> tuple[Frame, np.ndarray]:
        """One row per step of a seated x and other seat y: columns of meetings() with a step, and the row's pair in whole()."""
        acting = np.flatnonzero(self.actor >= 0)
        a, y, pair = self._others(acting, self.actor[acting])
        x, h = self.actor[a], self.a["hand"][0][a]
        of = lambda c, i: (c[0][i], c[1] if c[1] is True else c[1][i])
        sure = lambda v: (v, True)
        player, opened = self.s["player_idx"][0], self.opened[h]
        acts = np.append(self.a["player_idx"][0], np.int32(0)), np.append(self.a["nvol"][0], 0)
        names = {"street": "street", "act": "action", "amount": "amount", "tc": "to_call", "pot": "pot_before", **{c: c for c in ("aggr", "calls", "isfold", "nr", "l", "lall", "xagg", "nvol", "cao", "nc")}}
        columns = {c: of(self.a[f], a) for c, f in names.items()} | {
            "s": (False, True), "x": sure(player[x]), "y": sure(player[y]), "bb": sure(self.h["bb"][0].astype(np.int64)[h]), "xpos": of(self.pos, x), "ypos": of(self.pos, y), "nact": sure(self.n[h] - self.a["nf"][0][a]),
            "first": sure(a == self.first[x]), "ya": sure(self.fold[y] > a), "yd": sure(self.first[y] < a), "yv": sure(self.vol[y] < a), "yl": sure(self.limp[y] < a), "pfirst": sure(a == self.pfr[x]),
            "opener": (acts[0][opened], opened < self.none), "unopened": sure((opened < self.none) & (acts[1][opened] == 0)),
        }
        return Frame(columns, len(a)), pair
