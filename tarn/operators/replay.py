"""Replay of hands with all cards open: shares of the pot before and after every step, strengths, and heads-up shares."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tarn.operators import cards

#: Cards of the board by street.
KNOWN = (0, 3, 4, 5)
#: Values of seats over runs of the board that are worked out together.
TOGETHER = 1_000_000
_MATRIX = ArrayType(ArrayType(DoubleType()))


def _sums(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three sums over the last axis of cards."""
    return tuple(table[of].sum(-1, dtype=table.dtype) for table in (cards.FACE_SUM, cards.SHORT_SUITS, cards.BIT_SUM))


class _Street:
    """What the hands of a batch ask of one street: shares of the pot by who is in, and shares against each other alone."""

    def __init__(self, known: int):
        self.known, self.asked, self.shares, self.alone = known, {}, {}, {}

    def ask(self, hand: int, live: int) -> None:
        self.asked.setdefault(hand, []).append(live)

    def answer(self, holes: list, boards: list, ids: list, simulations: int) -> None:
        alike: dict[int, list[int]] = {}
        for i in self.asked:
            if len(boards[i]) >= self.known and len(holes[i]):
                alike.setdefault(int((holes[i] >= 0).sum()), []).append(i)
        for held, members in alike.items():
            runs = simulations if not self.known else math.comb(52 - held - self.known, 5 - self.known)
            step = max(1, TOGETHER // (6 * max(runs, 1)))
            for at in range(0, len(members), step):
                self._some(members[at : at + step], holes, boards, ids, simulations)

    def _some(self, members: list[int], holes: list, boards: list, ids: list, simulations: int) -> None:
        free = np.ones((len(members), 52), bool)
        for j, i in enumerate(members):
            free[j, holes[i][holes[i] >= 0]] = False
            free[j, boards[i][: self.known]] = False
        deck = np.nonzero(free)[1].reshape(len(members), -1)
        if self.known:
            every = np.array(list(combinations(range(deck.shape[1]), 5 - self.known)), np.int64)
            there = _sums(np.array([boards[i][: self.known] for i in members]))
            # A card's sums are picked once a hand; two or fewer cards are to come, as a hand has three on the board.
            come = [sum(table[deck][:, every[:, c]] for c in range(every.shape[1])) if every.shape[1] else table.dtype.type(0) for table in (cards.FACE_SUM, cards.SHORT_SUITS, cards.BIT_SUM)]
            board = tuple(t[:, None] + c for t, c in zip(there, come))
        else:
            board = _sums(deck[np.arange(len(members))[:, None, None], cards.places(cards.drawn(deck.shape[1], simulations, [int(ids[i]) for i in members]), 5)])
        # One row for each seat that is in at the street's first step.
        rows, seats = [], []
        begin = {}
        for j, i in enumerate(members):
            known = (holes[i] >= 0).all(1)
            in_ = [s for s in range(len(known)) if known[s] and self.asked[i][0] >> s & 1]
            begin[i] = {s: len(rows) + at for at, s in enumerate(in_)}
            rows += [j] * len(in_)
            seats += [holes[i][s] for s in in_]
        if not rows:
            return
        value = cards.face_values(tuple(b[rows] for b in board), tuple(s[:, None] for s in _sums(np.array(seats))), 7)
        runs = value.shape[1]
        pairs = [(i, x, y) for i in members for x, y in combinations(begin[i], 2)]
        if pairs:
            left, right = (value[[begin[p[0]][p[k]] for p in pairs]] for k in (1, 2))
            more, same = np.count_nonzero(left > right, axis=1), np.count_nonzero(left == right, axis=1)
            less, more, same = (runs - more - same) / runs, more / runs, 0.5 * (same / runs)
            for (i, x, y), m, l in zip(pairs, (more + same).tolist(), (less + same).tolist()):
                self.alone[i, x, y], self.alone[i, y, x] = m, l
        for i in members:
            self.alone |= {(i, x, x): 0.5 for x in begin[i]}
        sized: dict[int, list] = {}
        for i in members:
            known = begin[i]
            for live in dict.fromkeys(self.asked[i]):
                in_ = [s for s in range(len(holes[i])) if live >> s & 1]
                if in_ and all(s in known for s in in_):
                    sized.setdefault(len(in_), []).append((i, live, in_, [known[s] for s in in_]))
        for k, asked in sized.items():
            for at in range(0, len(asked), step := max(1, TOGETHER // (k * runs))):
                some = asked[at : at + step]
                own = value[np.array([a[3] for a in some])]  # hands, seats, runs
                best = own == own.max(1, keepdims=True)
                many = best.sum(1, dtype=np.int8)
                share = sum(np.count_nonzero(best & (many == j)[:, None], axis=2) / j for j in np.unique(many).tolist()) / runs
                for (i, live, in_, _), v in zip(some, share.tolist()):
                    full = [None] * len(holes[i])
                    for s, e in zip(in_, v):
                        full[s] = e
                    self.shares[i, live] = full


def _strengths(asked: list[tuple[int, int]], holes: list, boards: list, known: int) -> dict[tuple[int, int], float]:
    """cards.strengths() of seats (hand, seat) on their hands' boards of so many cards."""
    pairs = cards._two_cards()
    number, touch = np.zeros((52, 52), np.int64), np.zeros((52, len(pairs)), bool)
    for c in (0, 1):
        number[pairs[:, c], pairs[:, 1 - c]] = np.arange(len(pairs))
        touch[pairs[:, c], np.arange(len(pairs))] = True
    two, out = _sums(pairs), {}
    for at in range(0, len(asked), 500):
        some = asked[at : at + 500]
        hands = list(dict.fromkeys(i for i, _ in some))
        row = {i: j for j, i in enumerate(hands)}
        board = np.array([boards[i][:known] for i in hands])
        value = cards.face_values(tuple(s[:, None] for s in _sums(board)), tuple(s[None, :] for s in two), 2 + known)
        value[touch[board].any(1)] = -1
        own = np.array([holes[i][s] for i, s in some])
        every = value[[row[i] for i, _ in some]]
        mine = every[np.arange(len(some)), number[own[:, 0], own[:, 1]]][:, None]
        other = (every >= 0) & ~touch[own].any(1)
        beaten, even = np.count_nonzero((every < mine) & other, axis=1), np.count_nonzero((every == mine) & other, axis=1)
        out |= dict(zip(some, ((beaten + 0.5 * even) / np.count_nonzero(other, axis=1)).tolist()))
    return out


def _played(cards_: np.ndarray, board: np.ndarray) -> bool:
    """No card twice among known hole cards and the board, no hand half known."""
    known = np.concatenate([cards_[cards_ >= 0], board])
    return len(np.unique(known)) == len(known) and bool(((cards_ >= 0).all(1) | (cards_ < 0).all(1)).all())


@F.pandas_udf(StructType([StructField("eq", _MATRIX), StructField("eqp", _MATRIX), StructField("hs", ArrayType(DoubleType())), StructField("hu", _MATRIX)]))
def _replay(ids: pd.Series, holes: pd.Series, board: pd.Series, street: pd.Series, seat: pd.Series, fold: pd.Series, simulations: pd.Series) -> pd.DataFrame:
    own = [np.asarray(h, np.int64).reshape(-1, 2) for h in holes]
    boards = [np.asarray([] if b is None else b, np.int64) for b in board]
    return pd.DataFrame(replayed(ids.tolist(), own, boards, street, seat, fold, int(simulations.iloc[0]) if len(simulations) else 0), columns=["eq", "eqp", "hs", "hu"])


def replayed(ids: list, own: list, boards: list, street: list, seat: list, fold: list, simulations: int) -> list[tuple]:
    """(eq, eqp, hs, hu) of hands, as in replay()."""
    for i, (h, b) in enumerate(zip(own, boards)):
        if not _played(h, b):
            own[i] = np.full_like(h, -1)
    asks, strong, lives = [_Street(k) for k in KNOWN], [{} for _ in KNOWN], []
    for i, (ts, ss, fs) in enumerate(zip(street, seat, fold)):
        live, seen = (1 << len(own[i])) - 1, []
        known = (own[i] >= 0).all(1).tolist()
        for t, s, f in zip(ts.tolist(), ss.tolist(), fs.tolist()):
            after = live & ~(1 << s) if f and s >= 0 else live
            asks[t].ask(i, live)
            asks[t].ask(i, after)
            if t > 0 and s >= 0 and known[s] and len(boards[i]) >= KNOWN[t]:
                strong[t][i, s] = None
            seen.append((t, s, live, after))
            live = after
        lives.append(seen)
    for t, a in enumerate(asks):
        a.answer(own, boards, ids, simulations)
        strong[t] = _strengths(list(strong[t]), own, boards, KNOWN[t])
    rows = []
    for i, seen in enumerate(lives):
        n = len(own[i])
        none = [None] * n
        before = [asks[t].shares.get((i, live), none) for t, _, live, _ in seen]
        after = [asks[t].shares.get((i, live), none) for t, _, _, live in seen]
        hu = [[a.alone.get((i, x, y)) for x in range(n) for y in range(n)] if i in a.asked and n and len(boards[i]) >= a.known else None for a in asks]
        rows.append((before, after, [strong[t].get((i, s)) for t, s, _, _ in seen], hu))
    return rows


def replay(h: DataFrame, simulations: int = 400) -> DataFrame:
    """hand_rows() with equities: acts get eq and eqp (shares of the seats before and after the step, null for those who left), hs
    (the actor's strength against one random hand after the flop); the hand gets hu (by street, each seat's share against each
    other alone, as a flat matrix of those left at the street's start), and eq1 and tp of the seats' starting hands.

    Every dealt card that is known is out of the deck. After the flop all ways to complete the board are counted; before it,
    `simulations` seeded by the hand. A share is null where a player left has no known cards, or where cards contradict.
    """
    # Copies of one hand lie in one task already; the work is in the runs of the board, not in the bytes.
    tasks = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = F.expr("flatten(transform(seats, s -> array(coalesce(cast(s.c1 as int), -1), coalesce(cast(s.c2 as int), -1))))")
    dealt = F.expr("transform(filter(coalesce(board, array()), c -> c is not null), c -> cast(c as int))")
    seat = F.expr("transform(acts, a -> cast(coalesce(array_position(transform(seats, s -> s.p), a.player_idx), 0) as int) - 1)")
    streets, folds = F.expr("transform(acts, a -> cast(a.street as int))"), F.expr("transform(acts, a -> a.isfold)")
    r = h.repartition(tasks, "hand_idx").withColumn("__r", _replay("hand_idx", flat, dealt, streets, seat, folds, F.lit(simulations)))
    r = r.withColumn("acts", _extended(h))
    strength = cards.against_random()
    by_class = lambda table: F.create_map(*(F.lit(v) for pair in table.items() for v in pair))
    return r.withColumns(
        {"hu": F.col("__r.hu"), "eq1": F.transform("seats", lambda s: F.element_at(by_class(strength), s["cls"])), "tp": F.transform("seats", lambda s: F.element_at(by_class(cards.top_share(strength)), s["cls"]))}
    ).drop("__r")


def _extended(h: DataFrame):
    """The acts with their places in the replay's lists added."""
    names = [f.name for f in h.schema["acts"].dataType.elementType.fields]
    return F.transform("acts", lambda a, i: F.struct(*(a[n].alias(n) for n in names), F.get("__r.eq", i).alias("eq"), F.get("__r.eqp", i).alias("eqp"), F.get("__r.hs", i).alias("hs")))


_PRE, _POST = "get(a.eq, y.i)", "get(a.eqp, y.i)"
_FACING = "a.l = y.p and a.to_call > 0"
_ANSWER = """a.aggr and coalesce(y.fold_no > a.k, true) and coalesce(exists(acts, b -> b.player_idx = y.p and b.street = a.street and b.k > a.k and (b.calls or b.aggr)
    and not exists(acts, c -> coalesce(c.player_idx = x.p and c.street = a.street and c.aggr and c.k > a.k and c.k < b.k, false))), false)"""
_HE = "get(get(hu, cast(a.street as int)), x.i * size(seats) + y.i)"
#: Expressions for meetings() over replayed hands.
#: In seats of meetings() a seat has its place i; acts are those of the hand.
MORE_STEP = {
    "hs": "a.hs", "eqx": "get(a.eq, x.i)", "eqy": _PRE, "he": _HE, "hel": "get(get(hu, cast(a.street as int)), x.i * size(seats) + cast(array_position(transform(seats, w -> w.p), a.l) as int) - 1)",
    "xeq1": "get(eq1, x.i)", "xtp": "get(tp, x.i)", "ytp": "get(tp, y.i)", "answered": f"coalesce({_ANSWER} and {_HE} is not null, false)",
    "imp": f"((coalesce({_POST}, 0) - coalesce({_PRE}, 0)) * a.pot_before + coalesce({_POST}, 0) * a.amount) / bb",
    "gift": f"""greatest(0, case when {_FACING} and a.isfold then coalesce(get(a.eq, x.i), 0) * (a.pot_before + a.to_call) - a.to_call
        when {_FACING} and a.calls then a.amount - coalesce(get(a.eq, x.i), 0) * (a.pot_before + a.amount) when {_ANSWER} then coalesce(a.amount * (1 - 2 * {_HE}), 0) else 0 end) / bb""",
}
MORE_HAND = {
    "imps": """aggregate(filter(acts, b -> b.player_idx = x.p), 0D, (z, b) -> z + ((coalesce(get(b.eqp, y.i), 0) - coalesce(get(b.eq, y.i), 0)) * coalesce(b.pot_before, 0) + coalesce(get(b.eqp, y.i), 0) * coalesce(b.amount, 0)) / bb)""",
}
