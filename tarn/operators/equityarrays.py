"""Shares of the pot, heads-up shares and strengths on flat arrays over the hands of a batch, as replay.replayed() has them.

Only what is asked for is worked out. Who is in is a chain: every first fold takes one seat away, so the seats of a hand in
order of their folds, the last first, hold each set of those left as their first k.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from tarn.operators import cards
from tarn.operators.handarrays import Hands, spread

#: Cards of the board by street.
KNOWN = (0, 3, 4, 5)
#: Values that are worked out together.
TOGETHER = 800_000
_PAIRS = cards._two_cards()
#: Sums of FACE_SUM and SHORT_SUITS in one number, for one card: 16 bits hold the suits.
_BOTH = (cards.FACE_SUM.astype(np.int64) << 16) + cards.SHORT_SUITS
_KINDS, _KIND = np.unique(cards.FACE_SUM[_PAIRS].sum(1, dtype=np.int32), return_inverse=True)
_KIND = _KIND.reshape(-1)
_NUMBER = np.zeros((52, 52), np.int64)
_NUMBER[_PAIRS[:, 0], _PAIRS[:, 1]] = _NUMBER[_PAIRS[:, 1], _PAIRS[:, 0]] = np.arange(len(_PAIRS))
#: The 51 pairs of cards that hold a card.
_HOLDING = np.array([_NUMBER[c, np.delete(np.arange(52), c)] for c in range(52)])


@functools.cache
def _levels(n: int) -> tuple[np.ndarray, np.ndarray]:
    """cards.by_faces() and values of flushes as small numbers in the same order."""
    plain, flushes = cards.by_faces(n), cards._flushes()
    every = np.unique(np.concatenate([cards._plain(n)[1], flushes, [0]]))
    return np.searchsorted(every, np.minimum(plain, every[-1])).astype(np.int16), np.searchsorted(every, flushes).astype(np.int16)


def _counts(flags: np.ndarray) -> np.ndarray:
    """How many along the last axis, whose length is a multiple of 8."""
    if flags.shape[-1] > 8 * 255:
        return np.count_nonzero(flags, axis=-1)
    lanes = flags.view(np.uint64).sum(-1, dtype=np.uint64)
    return lanes[..., None].view(np.uint8).sum(-1, dtype=np.int64)


class Equities:
    """Known cards of a batch's seats and boards, and what is worked out from them."""

    def __init__(self, hands: Hands, board: np.ndarray, held: np.ndarray, ids: np.ndarray, simulations: int):
        """board: (hand, card), padded with -1; held: its cards by hand."""
        self.hands, self.board, self.held, self.ids, self.simulations = hands, board, held, ids, simulations
        (c1, k1), (c2, k2) = hands.s["c1"], hands.s["c2"]
        dealt = np.stack([np.where(k1, c1, -1), np.where(k2, c2, -1)], 1).astype(np.int64)
        owner = hands.s["hand"][0]
        # No card twice among known hole cards and the board, no hand half known.
        seen = np.zeros((hands.size, 52), np.int32)
        for of, card in ((owner, dealt[:, 0]), (owner, dealt[:, 1]), *((np.arange(hands.size), b) for b in board.T)):
            np.add.at(seen, (of[card >= 0], card[card >= 0]), 1)
        wrong = (seen > 1).any(1)
        wrong[owner[(dealt[:, 0] >= 0) != (dealt[:, 1] >= 0)]] = True
        dealt[wrong[owner]] = -1
        self.dealt, self.known = dealt, dealt[:, 0] >= 0
        self.out = np.bincount(owner, self.known * 2, hands.size).astype(np.int64)
        # Seats in order of their folds, the last first; beyond an unknown one no set is known.
        self.order = np.lexsort((hands.place, -hands.fold, owner))
        self.at = np.empty(len(owner), np.int64)
        self.at[self.order] = hands.place
        first = np.full(hands.size, np.iinfo(np.int64).max)
        np.minimum.at(first, owner[~self.known], self.at[~self.known])
        self.sure = first
        self.sums = _BOTH[np.maximum(dealt, 0)].sum(1)
        self.bits = cards.BIT_SUM[np.maximum(dealt, 0)].sum(1)

    def shares(self, slot: np.ndarray, count: np.ndarray, pair_slot: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of sets and pairs of seats. A slot is hand * 4 + street; a set is the `count` last to fold.

        (where the set's shares begin, by place of the seat; the shares, nan where there are none; x's share against y alone)
        """
        h = self.hands
        base = int(h.n.max(initial=0)) + 1
        keys, of = np.unique(slot * base + count, return_inverse=True)
        sets, k = np.divmod(keys, base)
        width = h.n[sets // 4]
        begin = np.cumsum(width) - width
        share, alone = np.full(int(width.sum()) + 1, np.nan), np.full(len(x), np.nan)
        one = np.unique(np.concatenate([sets, pair_slot]))
        hand, street = np.divmod(one, 4)
        good = (self.held[hand] >= np.array(KNOWN)[street]) & (h.n[hand] > 0)
        # The seats that are in at the street's first step and known, in order of their folds.
        i, j = spread(np.where(good, h.n[hand], 0))
        seat = self.order[h.off[hand[i]] + j]
        in_ = (h.fold[seat] >= h.start[one[i]]) & self.known[seat]
        i, seat = i[in_], seat[in_]
        m = np.bincount(i, minlength=len(one))
        rows = np.cumsum(m) - m
        group = (street * 64 + self.out[hand]) * 64 + m
        set_at, pair_at = np.searchsorted(one, sets), np.searchsorted(one, pair_slot)
        # A set is worked out if all its seats are known.
        fine = good[set_at] & (k > 0) & (k <= np.minimum(m[set_at], self.sure[sets // 4]))
        lone = (x != y) & good[pair_at] & self.known[x] & self.known[y] & (h.fold[x] >= h.start[pair_slot]) & (h.fold[y] >= h.start[pair_slot])
        rank = np.full(len(h.fold), -1)
        for g in np.unique(group[good & (m > 0)]):
            members = np.flatnonzero((group == g) & good)
            t, size, seats = int(g) >> 12, int(g) & 63, int(g) >> 6 & 63
            runs = self.simulations if not KNOWN[t] else math.comb(52 - seats - KNOWN[t], 5 - KNOWN[t])
            step = max(1, TOGETHER // (size * max(runs, 1)))
            inside_set, inside_pair = np.flatnonzero(fine & (group[set_at] == g)), np.flatnonzero(lone & (group[pair_at] == g))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                who = seat[rows[some][:, None] + np.arange(size)]
                value = self._values(hand[some], KNOWN[t], who, runs)
                low, high = some[0], some[-1]
                chosen = inside_set[slice(*np.searchsorted(set_at[inside_set], [low, high + 1]))]
                for n in np.unique(k[chosen]):
                    these = chosen[k[chosen] == n]
                    row = np.searchsorted(some, set_at[these])
                    share[begin[these][:, None] + h.place[who[row, :n]]] = _split(value, row, int(n), runs)
                two = inside_pair[(pair_at[inside_pair] >= low) & (pair_at[inside_pair] <= high)]
                if len(two):
                    row = np.searchsorted(some, pair_at[two])
                    rank[who.ravel()] = np.tile(np.arange(size), len(some))
                    alone[two] = _alone(value, row, rank[x[two]], rank[y[two]], runs)
        return begin[of], share, alone

    def _values(self, hand: np.ndarray, known: int, who: np.ndarray, runs: int) -> np.ndarray:
        """(hand, seat, run): the seats' values over runs of the board."""
        deck = self._deck(hand, known)
        need = 5 - known
        every = cards.drawn(deck.shape[1], runs, self.ids[hand]) if not known else cards.chosen(deck.shape[1], need)
        worth = _BOTH[deck]
        total = np.broadcast_to(_BOTH[self.board[hand, :known]].sum(1)[:, None], (len(hand), runs))
        for c in range(need):
            place = every >> 6 * c & 63
            total = total + (worth.take(place, 1) if known else worth.take(place + np.arange(len(hand), dtype=np.int32)[:, None] * deck.shape[1]))
        plain, flushes = _levels(7)
        face, suits = (total >> 16).astype(np.int32), (total & 0xFFFF).astype(np.uint16) + np.uint16(0x3333)
        own = self.sums[who]
        value = plain[face[:, None, :] + (own >> 16).astype(np.int32)[:, :, None]]
        suited = (suits[:, None, :] + (own & 0xFFFF).astype(np.uint16)[:, :, None]) & np.uint16(0x8888)
        at = np.flatnonzero(suited != 0)
        if len(at):
            i, s, r = (at // (suited.shape[1] * runs), at // runs % suited.shape[1], at % runs)
            come = cards.places(every[r] if known else every[i, r], need)
            bits = cards.BIT_SUM[deck[i[:, None], come]].sum(1) + cards.BIT_SUM[self.board[hand[i], :known]].sum(1) + self.bits[who[i, s]]
            mark = suited.ravel()[at]
            suit = ((mark >> 7) & 1) * 1 + ((mark >> 11) & 1) * 2 + ((mark >> 15) & 1) * 3
            flat = value.reshape(-1)
            flat[at] = np.maximum(flat[at], flushes[bits >> (13 * suit.astype(np.int64)) & 8191])
        return value

    def _deck(self, hand: np.ndarray, known: int) -> np.ndarray:
        free = np.ones((len(hand), 52), bool)
        i, j = spread(self.hands.n[hand])
        seat = self.hands.off[hand][i] + j
        i, seat = i[self.known[seat]], seat[self.known[seat]]
        free[i[:, None], self.dealt[seat]] = False
        free[np.arange(len(hand))[:, None], self.board[hand, :known]] = False
        return np.nonzero(free)[1].reshape(len(hand), -1)

    def strengths(self, slot: np.ndarray, seat: np.ndarray) -> np.ndarray:
        """cards.strengths() of seats at slots of later streets, nan where cards are missing."""
        out = np.full(len(slot), np.nan)
        hand, street = np.divmod(slot, 4)
        good = np.flatnonzero((street > 0) & self.known[seat] & (self.held[hand] >= np.array(KNOWN)[street]))
        for t in (1, 2, 3):
            mine = good[street[good] == t]
            boards = np.unique(hand[mine])
            known = KNOWN[t]
            dead, others = len(_PAIRS) - math.comb(52 - known, 2), math.comb(50 - known, 2)
            row = np.searchsorted(boards, hand[mine])
            order = np.argsort(row, kind="stable")
            mine, row = mine[order], row[order]
            for at in range(0, len(boards), 100):
                some = boards[at : at + 100]
                value = self._two_card_values(some, known)
                these = slice(*np.searchsorted(row, [at, at + len(some)]))
                asked, r = mine[these], row[these] - at
                own = self.dealt[seat[asked]]
                level = value[r, _NUMBER[own[:, 0], own[:, 1]]][:, None]
                all_ = value[r]
                touching = np.concatenate([all_[np.arange(len(r))[:, None], _HOLDING[own[:, c]]] for c in (0, 1)], 1)
                beaten = _several(all_, level, np.less) - dead - np.count_nonzero((touching < level) & (touching >= 0), axis=1)
                even = _several(all_, level, np.equal) - np.count_nonzero(touching == level, axis=1) + 1  # its own pair is in twice
                out[asked] = (beaten + 0.5 * even) / others
        return out

    def _two_card_values(self, hand: np.ndarray, known: int) -> np.ndarray:
        """(hand, pair of cards): values with the board's first cards, -1 for pairs that hold one of these."""
        board = self.board[hand, :known]
        plain, flushes = _levels(2 + known)
        value = plain[cards.FACE_SUM[board].sum(1, dtype=np.int32)[:, None] + _KINDS[None]][:, _KIND]
        suits = cards.SHORT_SUITS[board].sum(1)
        three = np.flatnonzero((suits + 0x5555) & 0x8888)  # three of a suit, without which no two cards make a flush
        if len(three):
            made = ((suits[three] + 0x3333)[:, None] + cards.SHORT_SUITS[_PAIRS].sum(1)[None]) & 0x8888
            i, p = np.nonzero(made)
            bits = cards.BIT_SUM[board[three]].sum(1)[i] + cards.BIT_SUM[_PAIRS].sum(1)[p]
            mark = made[i, p]
            suit = ((mark >> 7) & 1) * 1 + ((mark >> 11) & 1) * 2 + ((mark >> 15) & 1) * 3
            value[three[i], p] = np.maximum(value[three[i], p], flushes[bits >> (13 * suit) & 8191])
        for c in board.T:
            value[np.arange(len(hand))[:, None], _HOLDING[c]] = -1
        return value


def _several(values: np.ndarray, level: np.ndarray, compare) -> np.ndarray:
    """How many values of a row compare so with its level."""
    flags = np.zeros((len(values), -(-values.shape[1] // 8) * 8), bool)
    compare(values, level, out=flags[:, : values.shape[1]])
    return _counts(flags)


def _split(value: np.ndarray, row: np.ndarray, n: int, runs: int) -> np.ndarray:
    """(row, seat): shares of the first n seats of rows; equal best ones divide the pot."""
    if n == 1:
        return np.ones((len(row), 1))
    own = value[row, :n] if len(row) < len(value) or (row != np.arange(len(row))).any() else value[:, :n]
    best = np.zeros((len(row), n, -(-runs // 8) * 8), bool)
    np.equal(own, own.max(1, keepdims=True), out=best[:, :, :runs])
    won = _counts(best)
    many = best.view(np.uint64).sum(1, dtype=np.uint64).view(np.uint8)  # a byte a run
    i, r = np.divmod(np.flatnonzero(many > 1), many.shape[1])
    tied, split = best[i, :, r], many[i, r]
    sums = {j: np.stack([np.bincount(i[split == j], tied[split == j, s], len(row)) for s in range(n)], 1) for j in np.unique(split).tolist()}
    won = sum((v / j for j, v in sums.items()), won - sum(sums.values()))
    return won / runs


def _alone(value: np.ndarray, row: np.ndarray, x: np.ndarray, y: np.ndarray, runs: int) -> np.ndarray:
    left, right = value[row, x], value[row, y]
    flags = np.zeros((2, len(row), -(-runs // 8) * 8), bool)
    np.greater(left, right, out=flags[0, :, :runs])
    np.equal(left, right, out=flags[1, :, :runs])
    more, same = _counts(flags)
    return more / runs + 0.5 * (same / runs)
