"""Scores of the event catalogue, whole tables at a time: all that a score compares lies in one window of one table.

Hands come to their table in one exchange. From there to a pair's scores nothing else is moved: masks, counts, expectations and
tops are arrays of some tables at once. Tables of more than HOT_HANDS hands would not fit a task; they are left to the operators
of tarn.operators.events, which spread a table over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import baseline as B
from tarn.operators import events as E
from tarn.operators.handarrays import Hands

#: Hands valued together, as whole tables; and the size of a table that is not.
TOGETHER, HOT_HANDS = 1_500, 6_000


def by_table(hands: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f over gathered() hands, given as batches of whole tables. Hands without a table are left out."""
    together = TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []

        def ready(all_: bool) -> Iterator[pa.Table]:
            rest = pa.Table.from_batches(waiting).combine_chunks() if waiting else None
            waiting.clear()
            while rest is not None and rest.num_rows:
                ends = np.flatnonzero(np.diff(rest.column("table_idx").to_numpy())) + 1
                at = np.searchsorted(ends, together)
                if at == len(ends) and not all_:
                    waiting.extend(rest.to_batches())
                    return
                end = int(ends[at]) if at < len(ends) else rest.num_rows
                yield rest.slice(0, end).combine_chunks()
                rest = rest.slice(end)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) > together:
                for some in ready(False):
                    yield from f(some).to_batches()
        for some in ready(True):
            yield from f(some).to_batches()

    tasks = int(hands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hands.filter("table_idx is not null").repartition(tasks, "table_idx").sortWithinPartitions("table_idx").mapInArrow(run, schema)


def _newcomers(hands: Hands, table: np.ndarray, step: int) -> np.ndarray:
    """Seats whose player was not in the hand a step before at the table, if that hand is in the log."""
    seq, known = hands.h["hand_seq"]
    code = np.where(known, (table.astype(np.int64) << 34) + seq.astype(np.int64) + (1 << 32), -1)
    every = np.unique(code)
    hand, player = hands.s["hand"][0], np.unique(hands.s["player_idx"][0], return_inverse=True)[1].reshape(-1)
    wide = int(player.max(initial=0)) + 1
    there = np.searchsorted(every, code)[hand]
    at = np.minimum(np.searchsorted(every, code - step), len(every) - 1)
    met = (every[at] == code - step) & (code >= 0) & (every[at] >= 0)
    return met[hand] & ~np.isin(at[hand] * wide + player, there * wide + player)


def event_bits(hands: Hands, events: dict, more: dict) -> tuple[np.ndarray, np.ndarray]:
    """(event, pair of whole()): where the pair had an opportunity in the hand, and where the event came about."""
    whole = hands.whole()
    whole.columns |= {c: (v(hands), True) for c, v in more.items()}
    steps, pair = hands.steps()
    opp, hit = np.zeros((len(events), whole.size), bool), np.zeros((len(events), whole.size), bool)
    for i, (chance, then) in enumerate(events.values()):
        for to, sql in ((opp, f"({chance})"), (hit, f"({chance}) AND ({then})")):
            at, moved = whole.holds(sql), steps.holds(sql)
            if at is not False:
                to[i] |= at
            if moved is not False:
                to[i, pair if moved is True else pair[moved]] = True
    return opp, hit


class Scored:
    """Counts and scores of all events: rows are ordered pairs of a window and table, events one array each."""

    def __init__(self, batch: pa.Table, events: dict = E.EVENTS):
        hands = Hands(batch)
        table = hands.h["table_idx"][0]
        new, gone = _newcomers(hands, table, 1), _newcomers(hands, table, -1)
        more = {"xnew": lambda h: new[h.pair_x], "ynew": lambda h: new[h.pair_y], "xgone": lambda h: gone[h.pair_x], "ygone": lambda h: gone[h.pair_y]}
        self.events = list(events)
        opp, hit = event_bits(hands, events, more)
        (phase, p), (seq, q) = hands.h["phase"], hands.h["hand_seq"]
        inside = [(phase == at) & (seq >= low) & (True if high is None else seq < high) & p & q for at, low, high in E.WINDOWS.values()]
        other = hands.pair_x != hands.pair_y
        slots = [np.flatnonzero(i[hands.pair_hand] & other) for i in inside]
        slot, window = np.concatenate(slots), np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        names, member = np.unique(hands.s["player_idx"][0], return_inverse=True)
        member, wide = member.reshape(-1), len(names)
        place = window * (len(table) + 1) + np.unique(table, return_inverse=True)[1].reshape(-1)[hands.pair_hand[slot]]
        code = (place * wide + member[hands.pair_x[slot]]) * wide + member[hands.pair_y[slot]]
        order = np.argsort(code, kind="stable")
        self.code, starts = np.unique(code[order], return_index=True)
        slot, first = slot[order], slot[order][starts]
        self.window, self.table, self.size = window[order][starts], table[hands.pair_hand[first]], len(starts)
        x, y = member[hands.pair_x[first]], member[hands.pair_y[first]]
        place = self.code // (wide * wide)
        self.x, self.y = names[x], names[y]
        reverse = (place * wide + y) * wide + x
        self.up = np.flatnonzero(self.x < self.y)
        self.down = np.searchsorted(self.code, reverse[self.up])
        self._scope, self._row = self._groups(place), self._groups(place * wide + x)
        self._turned = np.argsort(place * wide + y, kind="stable")
        self._column = self._groups((place * wide + y)[self._turned])
        count = lambda bits: np.add.reduceat(bits[slot], starts, dtype=np.int64) if self.size else np.zeros(0, np.int64)
        self.opp, self.hit = (lambda i: count(opp[i])), (lambda i: count(hit[i]))

    @staticmethod
    def _groups(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where groups of equal neighbours begin, and the group of each."""
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        return starts, np.repeat(np.arange(len(starts)), np.diff(starts, append=len(code)))

    def _over(self, f: np.ufunc, v: np.ndarray, groups: tuple) -> np.ndarray:
        return f.reduceat(v, groups[0])[groups[1]]

    def _by_column(self, f: np.ufunc, v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        out[self._turned] = self._over(f, v[self._turned], self._column)
        return out

    def scores(self, opp: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """events.event_scores() of one event: expected, g, row_top and col_top; 0 and false without an opportunity."""
        there = opp > 0
        p = np.maximum(self._over(np.add, hit, self._scope) / np.maximum(self._over(np.add, opp, self._scope), 1), 1e-6)
        px = (self._over(np.add, hit, self._row) - hit + E.SHRINK * p) / (self._over(np.add, opp, self._row) - opp + E.SHRINK)
        py = (self._by_column(np.add, hit) - hit + E.SHRINK * p) / (self._by_column(np.add, opp) - opp + E.SHRINK)
        expected = opp * np.minimum(px * py / p, 1.0)
        f = np.maximum(expected, E.FLOOR)
        t = np.where(hit > 0, hit * np.log(np.maximum(hit, 1) / f), 0.0) - (hit - f)
        g = np.where(there, np.sign(hit - f) * 2 * np.maximum(t, 0.0), 0.0)
        gain = np.where(there, np.round(np.log((hit + 1) / (expected + 1)), 9), -np.inf)
        return expected, g, there & (gain == self._over(np.maximum, gain, self._row)), there & (gain == self._by_column(np.maximum, gain))

    def both_ways(self, opp: np.ndarray, g: np.ndarray, row: np.ndarray, column: np.ndarray) -> dict[str, np.ndarray]:
        """events.both_ways() of one event over the pairs of `up`; there says which have a row."""
        sides = {f"{n}_{d}": v[at] for d, at in (("ab", self.up), ("ba", self.down)) for n, v in (("g", g), ("rt", row), ("ct", column))}
        return sides | {"there": (opp[self.up] > 0) | (opp[self.down] > 0)}


def mined(batch: pa.Table) -> pa.Table:
    """events.mined() of whole tables."""
    s = Scored(batch)
    n = len(s.up)
    clip = lambda v: np.clip(v, 0.0, float(E.CAP))
    tops, sums, most, some = {k: np.zeros(n, np.int64) for k in (6, 10, 16)}, {c: np.zeros(n) for c in ("g_pos", "g_top", "g_sym")}, np.full(n, -np.inf), np.zeros(n, bool)
    for i, event in enumerate(s.events):
        if event in E.NOT_MINED or not n:
            continue
        opp, hit = s.opp(i), s.hit(i)
        _, g, row, column = s.scores(opp, hit)
        b = s.both_ways(opp, g, row, column)
        best = np.maximum(b["g_ab"], b["g_ba"])
        top = np.where(b["g_ab"] >= b["g_ba"], b["rt_ab"] & b["ct_ab"], b["rt_ba"] & b["ct_ba"])
        for k in tops:
            tops[k] += (best >= k) & top
        sums["g_pos"] += clip(best)
        sums["g_top"] += np.where(top, clip(best), 0.0)
        sums["g_sym"] += clip(np.minimum(b["g_ab"], b["g_ba"]))
        most = np.maximum(most, np.where(b["there"], best, -np.inf))
        some |= b["there"]
    names = np.array(list(E.WINDOWS))
    out = {"window": names[s.window[s.up]], "table_idx": s.table[s.up], "a": s.x[s.up], "b": s.y[s.up], **{f"k{k}": v for k, v in tops.items()}, "g_pos": sums["g_pos"], "g_top": sums["g_top"], "g_max": most, "g_sym": sums["g_sym"]}
    return pa.table({c: pa.array(v[some], pa.string() if c == "window" else None) for c, v in out.items()})


MINED = "window string, table_idx int, a int, b int, k6 bigint, k10 bigint, k16 bigint, g_pos double, g_top double, g_max double, g_sym double"


#: Flags of events.tail_flags() in the order of their numbers.
FLAGS = list(E.tail_flags())
#: pair: its row; else the window, or `redrawn`, in which the pair has the flag of the event.
FLAGGED = "table_idx int, a int, b int, kind string, event string, flag string"


def _tails(b: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Where each of FLAGS holds, in the pairs of both_ways()."""
    lesser, greater = np.minimum(b["g_ab"], b["g_ba"]), np.maximum(b["g_ab"], b["g_ba"])
    ab, ba, rows, both = b["rt_ab"] & b["ct_ab"], b["rt_ba"] & b["ct_ba"], b["rt_ab"] & b["rt_ba"], b["g_ab"] + b["g_ba"]
    out = [(ab & (b["g_ab"] >= k)) | (ba & (b["g_ba"] >= k)) for k in E.LEVELS["dirtop"]]
    out += [rows & (lesser >= k) for k in E.LEVELS["symtop"]] + [greater >= k for k in E.LEVELS["gmax"]]
    return [o & b["there"] for o in out + [both <= -k for k in E.LEVELS["deficit"]]]


def _drawn(heads: list[bytes], event: str, rates: np.ndarray, seed: str) -> np.ndarray:
    """The draws of events.redrawn() for cells whose keys begin with heads."""
    tail = f"|{event}|{seed}".encode()
    digits = b"".join([md5(h + tail).digest()[:7] for h in heads])
    high = np.frombuffer(digits, np.uint8).reshape(-1, 7).astype(np.int64)
    number = sum(high[:, i] << (8 * (6 - i)) for i in range(7)) >> 4  # 13 hex digits
    return B.poisson_quantile.func(pd.Series(number / float(16**13)), pd.Series(rates)).to_numpy()


def flagged(batch: pa.Table, seed: str = "event null") -> pa.Table:
    """Pairs of the first window, their flags in every window, and those after events.redrawn() in the first window."""
    s = Scored(batch)
    names = np.array(list(E.WINDOWS))
    first, pairs = s.window == 0, (s.window[s.up] == 0)
    found, kinds, events, flags = [], [], [], []

    def add(at: np.ndarray, kind: np.ndarray, event: str | None, flag: str | None) -> None:
        found.append(at)
        kinds.extend(kind)
        events.extend([event] * len(at))
        flags.extend([flag] * len(at))

    heads = np.array([f"first|{t}|{x}|{y}".encode() for t, x, y in zip(s.table[first].tolist(), s.x[first].tolist(), s.y[first].tolist())], object)
    some = np.zeros(len(s.up), bool)
    for i, event in enumerate(s.events if s.size else []):
        opp, hit = s.opp(i), s.hit(i)
        expected, *seen = s.scores(opp, hit)
        b = s.both_ways(opp, *seen)
        some |= b["there"] & pairs
        for flag, at in zip(FLAGS, _tails(b)):
            at = np.flatnonzero(at)
            add(at, names[s.window[s.up[at]]], event, flag)
        cells = first & (opp > 0)
        drawn = np.zeros_like(hit)
        drawn[cells] = np.minimum(_drawn(heads[opp[first] > 0], event, expected[cells], seed), opp[cells])
        only = np.where(cells, opp, 0)
        for flag, at in zip(FLAGS, _tails(s.both_ways(only, *s.scores(only, drawn)[1:]))):
            at = np.flatnonzero(at)
            add(at, np.full(len(at), "redrawn"), event, flag)
    at = np.flatnonzero(some)
    add(at, np.full(len(at), "pair"), None, None)
    row = np.concatenate(found)
    up = s.up[row]
    return pa.table({"table_idx": s.table[up], "a": s.x[up], "b": s.y[up], "kind": pa.array(kinds, pa.string()), "event": pa.array(events, pa.string()), "flag": pa.array(flags, pa.string())})


def hot_tables(hands: DataFrame, least: int | None = None) -> list[int]:
    """Tables of more than `least` hands; there are fewer than hands / least."""
    sizes = hands.filter("table_idx is not null").groupBy("table_idx").count().filter(F.col("count") > (HOT_HANDS if least is None else least))
    return sorted(r["table_idx"] for r in sizes.collect())
