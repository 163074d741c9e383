"""Card mathematics on arrays. A card is rank * 4 + suit, ranks 0-12 from deuce to ace; -1 is no card."""

from __future__ import annotations

import functools
import math
from collections import Counter
from itertools import combinations, combinations_with_replacement, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: The order of the cards' names.
RANKS = "23456789TJQKA"
SUITS = "cdhs"
CATEGORIES = ["high card", "pair", "two pair", "three of a kind", "straight", "flush", "full house", "four of a kind", "straight flush"]
_BITS = 1 << np.arange(13)


def _straight(mask: np.ndarray) -> np.ndarray:
    """Rank of the highest straight's top card in 13-bit rank masks, -1 without one; the ace also counts below the deuce."""
    wheel = (mask << 1) | (mask >> 12 & 1)
    runs = wheel & wheel >> 1 & wheel >> 2 & wheel >> 3 & wheel >> 4
    return np.where(runs > 0, np.floor(np.log2(np.maximum(runs, 1))).astype(np.int64) + 3, -1)


def _top(mask: np.ndarray, n: int) -> np.ndarray:
    """The n highest ranks of masks, packed in base 13 from the highest."""
    out, rest = np.zeros(len(mask), np.int64), mask.copy()
    for _ in range(n):
        high = np.where(rest > 0, np.floor(np.log2(np.maximum(rest, 1))).astype(np.int64), 0)
        out = out * 13 + high
        rest = rest & ~np.where(rest > 0, 1 << high, 0)
    return out


def score(cards: np.ndarray) -> np.ndarray:
    """Value of each row of five to seven cards; greater wins, equal ties. value // 13**5 is the category."""
    cards = np.asarray(cards, np.int64)
    n = len(cards)
    here = cards >= 0
    counts, suited = np.zeros((n, 13), np.int64), np.zeros((n, 4), np.int64)
    rows = np.arange(n)
    for j in range(cards.shape[1]):
        ok = here[:, j]
        counts[rows[ok], cards[ok, j] // 4] += 1
        suited[rows[ok], cards[ok, j] % 4] |= 1 << (cards[ok, j] // 4)
    mask = lambda least: ((counts >= least) * _BITS).sum(1)
    ones, twos, threes, fours = mask(1), mask(2), mask(3), mask(4)
    width = sum((suited >> r & 1) for r in range(13))
    flush = np.where(width >= 5, suited, 0).max(1)
    return _rules(ones, twos, threes, fours, flush)


def _rules(ones: np.ndarray, twos: np.ndarray, threes: np.ndarray, fours: np.ndarray, flush: np.ndarray) -> np.ndarray:
    """Value from the masks of ranks held at least once to four times, and of the ranks of a suit held five times (else 0)."""
    high, only, base = lambda m: _top(m, 1), lambda rank: 1 << rank, 13**5
    out = _top(ones, 5)
    put = lambda where, category, value: np.where(where, category * base + value, out)
    pair = high(twos)
    out = put(twos > 0, 1, pair * 13**3 + _top(ones & ~only(pair), 3))
    second = high(twos & ~only(pair))
    out = put((twos & (twos - 1)) > 0, 2, pair * 169 + second * 13 + high(ones & ~only(pair) & ~only(second)))
    triple = high(threes)
    out = put(threes > 0, 3, triple * 169 + _top(ones & ~only(triple), 2))
    line = _straight(ones)
    out = put(line >= 0, 4, np.maximum(line, 0))
    out = put(flush > 0, 5, _top(flush, 5))
    full = twos & ~only(triple)
    out = put((threes > 0) & (full > 0), 6, triple * 13 + high(full))
    quad = high(fours)
    out = put(fours > 0, 7, quad * 13 + high(ones & ~only(quad)))
    royal = _straight(flush)
    return put((flush > 0) & (royal >= 0), 8, np.maximum(royal, 0))


# Tables. A set of cards is three sums over its cards: counts of ranks (base 8), counts of suits (base 16), and one bit a card.

_CARD = np.arange(52, dtype=np.int64)
RANK_SUM, SUIT_SUM, BIT_SUM = np.int64(8) ** (_CARD // 4), np.int64(16) ** (_CARD % 4), np.int64(1) << (_CARD % 4 * 13 + _CARD // 4)


@functools.cache
def _plain(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank sums of n cards, sorted, and the value of each without regard to suits."""
    ranks = np.array([c for c in combinations_with_replacement(range(13), n) if max(Counter(c).values()) <= 4])
    counts = (ranks[:, :, None] == np.arange(13)).sum(1)
    mask = lambda least: ((counts >= least) * _BITS).sum(1)
    sums = (counts * np.int64(8) ** np.arange(13, dtype=np.int64)).sum(1)
    order = np.argsort(sums)
    return sums[order], _rules(mask(1), mask(2), mask(3), mask(4), np.zeros(len(ranks), np.int64))[order]


#: A number a rank, such that no two sets of up to seven cards (four of a rank at most) have the same size and sum.
FACES = np.array([0, 1, 5, 22, 98, 453, 2031, 8698, 22854, 83661, 262349, 636345, 1479181], np.int32)
FACE_SUM, SHORT_SUITS = FACES[_CARD // 4], SUIT_SUM.astype(np.int32)


@functools.cache
def by_faces(n: int) -> np.ndarray:
    """Value of n cards (five to seven) without regard to suits, by the sum of their FACES; anything for sets with five of a rank."""
    sums, value = _plain(n)
    faces = sum((sums >> (3 * r) & 7) * int(FACES[r]) for r in range(13))
    out = np.zeros(n * int(FACES[-1]) + 1, np.int32)
    out[faces] = value
    return out


def face_values(first: tuple, second: tuple, n: int) -> np.ndarray:
    """score() of n cards, a part of them in the one and the rest in the other: each has sums of FACE_SUM, SHORT_SUITS and
    BIT_SUM, of shapes that go together."""
    out = by_faces(n)[first[0] + second[0]]
    flush = np.nonzero((first[1] + second[1] + np.int32(0x3333)) & np.int32(0x8888))
    if len(flush[0]):
        at = lambda a: np.broadcast_to(a, out.shape)[flush]
        suits, bits = at(first[1]) + at(second[1]) + 0x3333, at(first[2]) + at(second[2])
        suit = sum(((suits >> (4 * s + 3)) & 1) * s for s in range(4))
        out[flush] = np.maximum(out[flush], _flushes()[bits >> (13 * suit) & 8191])
    return out


@functools.cache
def _flushes() -> np.ndarray:
    """Value by the mask of a suit's ranks, 0 below five of them."""
    masks = np.arange(8192)
    enough = np.array([m.bit_count() >= 5 for m in range(8192)])
    none = np.zeros(8192, np.int64)
    return np.where(enough, _rules(masks, none, none, none, masks), 0)


def values(rank_sum: np.ndarray, suit_sum: np.ndarray, bit_sum: np.ndarray, n: int) -> np.ndarray:
    """score() of sets of n cards (five to seven) given as sums; any shape."""
    sums, table = _plain(n)
    out = table[np.searchsorted(sums, rank_sum)]
    flush = np.flatnonzero((suit_sum + 0x3333) & 0x8888)
    if len(flush):
        bits, best = bit_sum.ravel()[flush], np.zeros(len(flush), np.int64)
        for s in range(4):
            best = np.maximum(best, _flushes()[bits >> (13 * s) & 8191])
        out.ravel()[flush] = np.maximum(out.ravel()[flush], best)
    return out


def describe(value: int) -> str:
    """Category and significant ranks of a value, as `full house AK`."""
    category, rest = divmod(int(value), 13**5)
    shown = [5, 4, 3, 3, 1, 5, 2, 2, 1][category]
    return f"{CATEGORIES[category]} " + "".join(RANKS[rest // 13**i % 13] for i in reversed(range(shown)))


@functools.cache
def chosen(n: int, k: int) -> np.ndarray:
    """All k of n places, six bits a place, ordered by the last, then the one before it: those of fewer places come first."""
    if not k:
        return np.zeros(1, np.int32)
    parts = [chosen(c, k - 1) + (c << 6 * (k - 1)) for c in range(k - 1, n)]
    return np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's mix of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def drawn(n: int, simulations: int, seeds: np.ndarray) -> np.ndarray:
    """(seed, run): seeded boards as five chosen() places in a deck of n cards, each set as likely as any other."""
    step = np.uint64(0x9E3779B97F4A7C15)
    start = _mixed(np.asarray(seeds, np.int64).astype(np.uint64) + step)
    u = _mixed(start[:, None] + np.arange(1, simulations + 1, dtype=np.uint64) * step) >> np.uint64(11)
    return chosen(n, 5).take((u * (math.comb(n, 5) * 2.0**-53)).astype(np.int64))


def places(code: np.ndarray, k: int) -> np.ndarray:
    """The k places of chosen() ones, on a last axis."""
    return np.stack([code >> 6 * c & 63 for c in range(k)], -1) if k else np.zeros((*code.shape, 0), np.int32)


def _boards(deck: np.ndarray, known: int, simulations: int, seed: np.ndarray) -> np.ndarray:
    """(hand, run, card): all ways to complete a board of `known` cards from each hand's deck, or seeded random ones."""
    need = 5 - known
    if known:
        every = list(combinations(range(deck.shape[1]), need))
        return deck[:, np.array(every, np.int64).reshape(len(every), need)]
    return deck[np.arange(len(deck))[:, None, None], places(drawn(deck.shape[1], simulations, seed), 5)]


def run_values(holes: np.ndarray, board: np.ndarray, known: int, seed: np.ndarray, simulations: int = 400) -> np.ndarray:
    """(hand, run, seat): the value of every seat's hand for every way to complete the board, all known cards being out of the
    deck. holes is (hand, seat, 2) with -1 for unknown cards, whose value is -1; all hands have as many known cards."""
    n, seats = holes.shape[:2]
    free = np.ones((n, 53), bool)
    rows = np.arange(n)[:, None]
    free[rows, np.where(holes >= 0, holes, 52).reshape(n, -1)] = False
    free[rows, board[:, :known]] = False
    free[:, 52] = False
    deck = np.nonzero(free)[1].reshape(n, -1)
    runs = _boards(deck, known, simulations, seed)
    own = np.maximum(holes, 0)
    parts = []
    for table in (RANK_SUM, SUIT_SUM, BIT_SUM):
        fixed = table[board[:, :known]].sum(1)[:, None] + table[runs].sum(2)
        parts.append(fixed[:, :, None] + table[own].sum(2)[:, None, :])
    out = values(*parts, 7)
    return np.where((holes >= 0).all(2)[:, None, :], out, -1)


def shares(run: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Each live seat's mean share of the pot over runs of one hand: (run, seat), live seats -> (live,)."""
    own = run[:, live]
    best = own == own.max(1, keepdims=True)
    return (best / best.sum(1, keepdims=True)).mean(0)


def equity(holes: list[tuple[int, int]], board: list[int], simulations: int = 0, seed: int = 0) -> np.ndarray:
    """Each hand's share of the pot over all ways to complete the board; before the flop over seeded random ones, or all
    1.7 million of two hands if simulations is 0."""
    own, b = np.array([holes], np.int64), np.array([board], np.int64).reshape(1, -1)
    if not board and not simulations:
        deck = np.array([c for c in range(52) if c not in {c for h in holes for c in h}])
        total, done = np.zeros(len(holes)), 0
        every = combinations(deck.tolist(), 5)
        while chunk := list(islice(every, 200_000)):
            runs = np.array(chunk, np.int64)
            parts = [t[runs].sum(1)[:, None] + t[own[0]].sum(1)[None, :] for t in (RANK_SUM, SUIT_SUM, BIT_SUM)]
            total += shares(values(*parts, 7), np.arange(len(holes))) * len(runs)
            done += len(runs)
        return total / done
    return shares(run_values(own, b, len(board), np.array([seed]), simulations)[0], np.arange(len(holes)))


def win_tie(first: tuple[int, int], second: tuple[int, int], board: list[int]) -> tuple[float, float]:
    """Chances that the first of two hands wins and that they tie, over all ways to complete a board of three cards or more."""
    run = run_values(np.array([[first, second]], np.int64), np.array([board], np.int64), len(board), np.array([0]))[0]
    return float((run[:, 0] > run[:, 1]).mean()), float((run[:, 0] == run[:, 1]).mean())


@functools.cache
def _two_cards() -> np.ndarray:
    return np.array(list(combinations(range(52), 2)), np.int64)


def strengths(holes: np.ndarray, board: np.ndarray) -> np.ndarray:
    """Chance of each seat (seat, 2) to beat one unseen random hand on a board of three to five cards, ties counting half; nan
    for unknown cards. All two-card hands are valued once for the board."""
    pairs = _two_cards()
    pairs = pairs[~np.isin(pairs, board).any(1)]
    sums = [t[board].sum() + t[pairs].sum(1) for t in (RANK_SUM, SUIT_SUM, BIT_SUM)]
    value = values(*sums, 2 + len(board))
    out = np.full(len(holes), np.nan)
    for i, (x, y) in enumerate(holes):
        if x < 0 or y < 0:
            continue
        has_x, has_y = (pairs == x).any(1), (pairs == y).any(1)
        mine = value[has_x & has_y][0]
        others = value[~(has_x | has_y)]
        out[i] = ((others < mine).sum() + 0.5 * (others == mine).sum()) / len(others)
    return out


@functools.cache
def against_random(opponents: int = 1, simulations: int = 10_000, seed: int = 169) -> dict[str, float]:
    """Share of the pot of each of the 169 starting hands against so many random ones, over seeded deals to the river."""
    out = {}
    for i, (high, low, kind) in enumerate((h, l, k) for h in range(13) for l in range(h + 1) for k in ("so" if h > l else " ")):
        own = np.array([high * 4, low * 4 + (kind != "s")])
        deck = np.setdiff1d(np.arange(52), own)
        rng = np.random.default_rng([seed, opponents, i])
        dealt = deck[np.argpartition(rng.random((simulations, 50)), 5 + 2 * opponents, axis=1)[:, : 5 + 2 * opponents]]
        board = [t[dealt[:, :5]].sum(1) for t in (RANK_SUM, SUIT_SUM, BIT_SUM)]
        mine = values(*(b + t[own].sum() for b, t in zip(board, (RANK_SUM, SUIT_SUM, BIT_SUM))), 7)
        held = [dealt[:, 5 + 2 * j : 7 + 2 * j] for j in range(opponents)]
        other = np.array([values(*(b + t[h].sum(1) for b, t in zip(board, (RANK_SUM, SUIT_SUM, BIT_SUM))), 7) for h in held])
        best, ties = other.max(0), (other == mine).sum(0)
        out[RANKS[high] + RANKS[low] + kind.strip()] = float(np.where(mine > best, 1.0, np.where(mine == best, 1.0 / (1 + ties), 0.0)).mean())
    return out


def top_share(strength: dict[str, float]) -> dict[str, float]:
    """For each starting hand the share of all 1,326 two-card hands that are at least as strong."""
    combos = {c: 6 if len(c) == 2 else 4 if c[2] == "s" else 12 for c in strength}
    out, above = {}, 0
    for c in sorted(strength, key=lambda c: (-strength[c], c)):
        above += combos[c]
        out[c] = above / 1326
    return out


#: The published groups of starting hands, strongest first; all others are in group 9.
GROUPS = [
    "AA KK QQ JJ AKs", "TT AQs AJs KQs AKo", "99 JTs QJs KJs ATs AQo", "T9s KQo 88 QTs 98s J9s AJo KTs",
    "77 87s Q9s T8s KJo QJo JTo 76s 97s A9s A8s A7s A6s A5s A4s A3s A2s 65s", "66 ATo 55 86s KTo QTo 54s K9s J8s 75s",
    "44 J9o 64s T9o 53s 33 98o 43s 22 K8s K7s K6s K5s K4s K3s K2s T7s Q8s", "87o A9o Q9o 76o 42s 32s 96s 85s J8o J7s 65o 54o 74s K9o T8o",
]


def group_of(name: Column) -> Column:
    """Group of a starting hand, null without one."""
    out = F.when(name.isNotNull(), F.lit(9))
    for i, hands in enumerate(GROUPS, 1):
        out = F.when(name.isin(hands.split()), F.lit(i)).otherwise(out)
    return out


def grid_index(c1: Column, c2: Column) -> Column:
    """Place in the 13 x 13 grid that begins with the ace: suited hands above the diagonal, others below."""
    high, low = 12 - F.greatest(F.floor(c1 / 4), F.floor(c2 / 4)), 12 - F.least(F.floor(c1 / 4), F.floor(c2 / 4))
    return F.when(F.pmod(c1, F.lit(4)) == F.pmod(c2, F.lit(4)), high * 13 + low).otherwise(low * 13 + high).cast("int")


def class_169(c1: Column, c2: Column) -> Column:
    """Starting hand as text: higher rank, lower rank, s or o; a pair has two characters."""
    r1, r2 = F.floor(c1 / 4), F.floor(c2 / 4)
    name = lambda r: F.substring(F.lit(RANKS), (r + 1).cast("int"), F.lit(1))
    high, low = F.greatest(r1, r2), F.least(r1, r2)
    suit = F.when(r1 == r2, "").when(F.pmod(c1, F.lit(4)) == F.pmod(c2, F.lit(4)), "s").otherwise("o")
    return F.when(c1.isNotNull() & c2.isNotNull(), F.concat(name(high), name(low), suit))


def chen(c1: Column, c2: Column) -> Column:
    """Chen's points of a starting hand."""
    r1, r2 = F.floor(c1 / 4), F.floor(c2 / 4)
    high, gap = F.greatest(r1, r2), F.abs(r1 - r2) - 1
    points = F.when(high == 12, 10.0).when(high == 11, 8.0).when(high == 10, 7.0).when(high == 9, 6.0).otherwise((high + 2) / 2)
    suited = F.when(F.pmod(c1, F.lit(4)) == F.pmod(c2, F.lit(4)), 2.0).otherwise(0.0)
    penalty = F.when(gap <= 0, 0.0).when(gap == 1, 1.0).when(gap == 2, 2.0).when(gap == 3, 4.0).otherwise(5.0)
    bonus = F.when((gap <= 1) & (high < 10), 1.0).otherwise(0.0)
    return F.ceil(F.when(r1 == r2, F.greatest(points * 2, F.lit(5.0))).otherwise(points + suited - penalty + bonus))


@F.pandas_udf(ArrayType(LongType()))
def street_values(c1: pd.Series, c2: pd.Series, b1: pd.Series, b2: pd.Series, b3: pd.Series, b4: pd.Series, b5: pd.Series) -> pd.Series:
    """score() of two hole cards with the first three, four and five cards of the board; null where a card is missing."""
    cards = np.column_stack([x.fillna(-1).to_numpy(np.int64) for x in (c1, c2, b1, b2, b3, b4, b5)])
    out = np.full((len(cards), 3), np.nan)
    for k in (5, 6, 7):
        good = (cards[:, :k] >= 0).all(1)
        own = cards[good, :k]
        out[good, k - 5] = values(*(t[own].sum(1) for t in (RANK_SUM, SUIT_SUM, BIT_SUM)), k)
    return pd.Series([[None if np.isnan(v) else int(v) for v in row] for row in out])


@F.pandas_udf(StringType())
def described(value: pd.Series) -> pd.Series:
    """describe() of values."""
    names = {v: describe(v) for v in value.dropna().unique()}
    return value.map(names, na_action="ignore")
