"""pairhand.pairs() with equities on flat arrays: hands are replayed and their pairs' features gathered a batch at a time.

The features are those of the catalogues in tarn.operators.pairhand: aggregates over steps are taken here, expressions over a
hand and the combination of both directions stay Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tarn.operators import cards, handarrays, pairhand
from tarn.operators.equityarrays import Equities
from tarn.operators.handarrays import Frame, Hands, _before, plain, spread

#: Hands replayed together.
TOGETHER = 2_000
#: Boards before the flop.
SIMULATIONS = 400
#: Rows that wait to be summed by pair.
WAITING = 200_000
#: Cells of population rates: class, raises, place, callers.
CELLS = (169, 4, 6, 3)
_STEP = re.compile(r"(?:coalesce\()?(min|max)\(CASE WHEN (?!s THEN)(.*) THEN (?:coalesce\((\w+), ([\d.]+)\)|(\w+)) END\)(?:, (-?[\d.]+)\))?$")
_COUNT = re.compile(r"CAST\(sum\(CASE WHEN (.*) THEN 1 ELSE 0 END\) AS INT\)$")
_WHOLE = re.compile(r"max\(CASE WHEN s THEN (.*) END\)$")
_PLAIN = re.compile(r"coalesce\((sum|max)\((\w+)\), 0\)$")
EVERY = pairhand.FEATURES | pairhand.COMMON | pairhand.EQUITY
#: Columns of the hand and pair that expressions over the hand need, by type.
RAW = {
    **dict.fromkeys(("xvol", "sandwich", "xsd", "ysd"), "boolean"), **dict.fromkeys(("tf", "tf_pre", "tf_act", "both_st", "hu_st", "hu_still", "nb", "nvols", "npre", "nleft", "xfold_st", "yfold_st", "y", "bb", "final_pot"), "int"),
    "xfirst_act": "tinyint", "xfirst_l": "int", "xpfr_no": "smallint", "xfold_no": "smallint", "yaggr_no": "smallint", "yfirst_no": "smallint", "xnet": "int", "xpos": "int",
}
TAKEN = {f: "int" if _COUNT.match(e) else "double" for f, e in EVERY.items() if not _WHOLE.match(e)}


def classes(hands: Hands) -> np.ndarray:
    """The seats' starting hands as numbers, -1 without one."""
    (c1, k1), (c2, k2) = hands.s["c1"], hands.s["c2"]
    c1, c2 = c1.astype(np.int64), c2.astype(np.int64)
    high, low = np.maximum(c1 // 4, c2 // 4), np.minimum(c1 // 4, c2 // 4)
    return np.where(np.asarray(k1) & np.asarray(k2), np.where(c1 % 4 == c2 % 4, high * 13 + low, low * 13 + high), -1)


def class_number(name: str) -> int:
    high, low = cards.RANKS.index(name[0]), cards.RANKS.index(name[1])
    return high * 13 + low if name.endswith("s") else low * 13 + high


def _cells(hands: Hands, steps: np.ndarray, seats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rates' cell of steps by seats, and where there is one."""
    pos, known = hands.pos
    kind = classes(hands)
    good = (hands.a["street"][0][steps] == 0) & (kind[seats] >= 0) & known[seats]
    cell = np.ravel_multi_index((np.where(good, kind[seats], 0), np.minimum(hands.a["nr"][0][steps], 3), np.where(good, pos[seats], 0), np.minimum(hands.a["nc"][0][steps], 2)), CELLS)
    return cell, good


def _slices(f: Callable[[pa.Table], pa.Table]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield from f(pa.Table.from_batches([batch.slice(at, TOGETHER)]).combine_chunks()).to_batches()

    return run


def rates(hands: DataFrame, seats: DataFrame, steps: DataFrame) -> np.ndarray:
    """(3, cells): pairhand.population_rates() of a log: of raises, folds and calls. Of later streets only the steps' street is
    gathered."""
    early = lambda c: F.when(F.coalesce("street", F.lit(0)) == 0, F.col(c)).alias(c)
    fields = ["player_idx", "action", "amount", "to_call"]
    log = handarrays.gathered(
        hands.select("hand_idx", "button_seat", F.lit(1).alias("bb"), F.expr("cast(array() as array<tinyint>)").alias("board")), seats.select("hand_idx", "player_idx", "seat_no", "c1", "c2"),
        steps.select("hand_idx", "action_no", "street", *map(early, fields)), ["seat_no", "c1", "c2"], ["street", *fields],
    )

    def count(batch: pa.Table) -> pa.Table:
        h = Hands(batch)
        steps = np.flatnonzero(h.actor >= 0)
        cell, good = _cells(h, steps, h.actor[steps])
        cell, steps = cell[good], steps[good]
        size = int(np.prod(CELLS))
        n = [np.bincount(cell, None if c is None else h.a[c][0][steps], size).astype(np.int64) for c in (None, "aggr", "isfold", "calls")]
        some = np.flatnonzero(n[0])
        return pa.table({"cell": some, **{f"n{i}": v[some] for i, v in enumerate(n)}})

    rows = log.mapInArrow(_slices(count), "cell bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint").groupBy("cell").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))
    n = np.zeros((4, *CELLS))
    for r in rows.collect():  # at most 12,168 rows
        n[(slice(None), *np.unravel_index(r[0], CELLS))] = r[1:]
    coarse = n.sum((3, 4), keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(n[:1] >= pairhand.LEAST_CELL, n[1:] / n[:1], coarse[1:] / coarse[:1])
    return out.reshape(3, -1)


def _boards(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hand, card): known cards of the boards, padded with -1, and how many."""
    column = batch.column("board").combine_chunks()
    counts = np.diff(column.offsets.to_numpy()) * (1 if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False))
    (card, there), owner = plain(column.flatten()), np.repeat(np.arange(len(counts)), counts)
    card, owner = (card, owner) if there is True else (card[there], owner[there])
    held = np.bincount(owner, minlength=len(counts))
    out = np.full((len(counts), max(5, int(held.max(initial=0)))), -1)
    out[owner, spread(held)[1]] = card
    return out, held


def _open(hands: Hands, batch: pa.Table, steps: Frame, pair: np.ndarray, a: np.ndarray, x: np.ndarray, y: np.ndarray, strength: np.ndarray) -> None:
    """Adds to the steps what needs equities."""
    e = Equities(hands, *_boards(batch), batch.column("hand_idx").to_numpy(), SIMULATIONS)
    hand, street = hands.a["hand"][0], hands.a["street"][0].astype(np.int64)
    # Y calls or raises later in the street, before X raises again.
    n, slot = len(hand) + 1, lambda s: s * 4 + street[a]
    aggr, calls, fold = (hands.a[c][0] for c in ("aggr", "calls", "isfold"))
    own = np.where(hands.actor >= 0, (hands.actor * 4 + street) * n + np.arange(n - 1), -1)

    def later(flag: np.ndarray, who: np.ndarray) -> np.ndarray:
        keys = np.append(np.sort(own[flag & (own >= 0)]), np.iinfo(np.int64).max)
        found = keys[np.searchsorted(keys, slot(who) * n + a, side="right")]
        return np.where(found // n == slot(who), found % n, n)

    answer = later(aggr | calls, y)
    answered = aggr[a] & (hands.fold[y] > a) & (answer < n) & (later(aggr, x) > answer)
    (amount, ka), (tc, kt), (pot, kp) = (hands.a[c] for c in ("amount", "to_call", "pot_before"))
    facing = np.broadcast_to(steps.holds("l = y AND tc > 0"), a.shape)
    # Shares before and after a step are asked for where they count: a check or an unheeded step moves nothing.
    acting = hands.actor >= 0
    gone = fold & acting & (hands.fold[np.maximum(hands.actor, 0)] == np.arange(len(hand))) if len(hands.fold) else np.zeros(len(hand), bool)
    left = hands.n[hand] - _before(gone, hand)
    ask = np.stack([gone | ((fold | calls) & (tc > 0)), gone | (amount != 0)]) & acting
    here = hand * 4 + street
    lone = np.flatnonzero((facing & (fold | calls)[a] & (street[a] > 0)) | answered)
    begin, share, alone = e.shares(np.concatenate([here[ask[0]], here[ask[1]]]), np.concatenate([left[ask[0]], (left - gone)[ask[1]]]), here[a[lone]], x[lone], y[lone])
    start = np.full((2, len(hand)), len(share) - 1)
    start[0, ask[0]], start[1, ask[1]] = np.split(begin, [np.count_nonzero(ask[0])])
    at = lambda i, s: share[np.minimum(start[i][a] + hands.place[s], len(share) - 1)]
    eqx, pre, post, he = at(0, x), np.nan_to_num(at(0, y)), np.nan_to_num(at(1, y)), np.full(len(a), np.nan)
    he[lone] = alone
    pre = np.where(gone[a], pre, post)
    tested = np.flatnonzero(acting & (street > 0) & (fold | calls | (hands.a["action"][0] == 1)))
    strong = np.full(len(hand), np.nan)
    strong[tested] = e.strengths(here[tested], hands.actor[tested])
    known = lambda v: (np.nan_to_num(v), ~np.isnan(v))
    sure = lambda k: np.broadcast_to(np.asarray(k), hand.shape)[a]
    amount, tc, pot, ka, kt, kp, bb = amount.astype(float)[a], tc.astype(float)[a], pot.astype(float)[a], sure(ka), sure(kt), sure(kp), steps.columns["bb"][0]
    zero = np.nan_to_num(eqx)
    folded, called = facing & fold[a], facing & calls[a]
    given = np.where(folded, np.where(kp & kt, zero * (pot + tc) - tc, 0), np.where(called, np.where(kp & ka, amount - zero * (pot + amount), 0), np.where(answered & ka, amount * np.nan_to_num(1 - 2 * he), 0)))
    steps.columns |= {
        "hs": known(strong[a]), "eqx": known(eqx), "he": known(he), "xeq1": known(strength[classes(hands)[x]]), "answered": (answered & ~np.isnan(he), True),
        "imp": (((post - pre) * pot + post * amount) / bb, kp & ka), "gift": (np.maximum(given, 0) / bb, True),
    }


def _sandwiches(hands: Hands, size: int) -> np.ndarray:
    """Pairs one of whom raised again before the flop after the other's raise, a third having come in between."""
    out = np.zeros(size, bool)
    hand, player, aggr = hands.a["hand"][0], hands.a["player_idx"][0], hands.a["aggr"][0]
    enters = np.flatnonzero(hands.enters)
    raises = np.bincount(hand[enters], aggr[enters], hands.size)
    enters = enters[raises[hand[enters]] >= 2]
    for some in np.split(enters, np.flatnonzero(np.diff(hand[enters])) + 1) if len(enters) else []:
        h, seats, who, up = hand[some[0]], hands.actor[some].tolist(), player[some].tolist(), aggr[some].tolist()
        for i in range(len(some)):
            for j in range(i + 2, len(some)) if up[i] else ():
                p, q, between = who[i], who[j], range(i + 1, j)
                if up[j] and p != q and not any(up[c] and who[c] in (p, q) for c in between) and any(who[z] not in (p, q) for z in between) and min(seats[i], seats[j]) >= 0:
                    u, v = hands.place[seats[i]], hands.place[seats[j]]
                    out[hands.pair_off[h] + np.array([u * hands.n[h] + v, v * hands.n[h] + u])] = True
    return out


def _taken(expression: str, steps: Frame, pair: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray | bool]:
    """An aggregate over the steps of every pair."""
    if m := _COUNT.match(expression):
        at = steps.holds(m[1])
        return (np.zeros(size, np.int32) if at is False else np.bincount(pair if at is True else pair[at], minlength=size).astype(np.int32)), True
    if m := _PLAIN.match(expression):
        (v, filled), f, none = steps.columns[m[2]], m[1], 0.0
        at = np.broadcast_to(np.asarray(filled), pair.shape)
    else:
        m = _STEP.match(expression)
        f, none = m[1], None if m[6] is None else float(m[6])
        v, filled = steps.columns[m[3] or m[5]]
        at, filled = np.broadcast_to(steps.holds(m[2]), pair.shape), np.broadcast_to(np.asarray(filled), pair.shape)
        v, at = (np.where(filled, v, float(m[4])), at) if m[3] else (v, at & filled)
    if f == "sum":
        return np.bincount(pair[at], v[at], size), True
    out = np.full(size, np.inf if f == "min" else -np.inf)
    (np.minimum if f == "min" else np.maximum).at(out, pair[at], v[at])
    there = np.isfinite(out)
    return (np.where(there, out, 0.0 if none is None else none), there if none is None else True)


def strengths() -> np.ndarray:
    """cards.against_random() by class_number(), nan in the last place for none."""
    out = np.full(170, np.nan)
    for name, v in cards.against_random().items():
        out[class_number(name)] = v
    return out


def features(batch: pa.Table, rates_: np.ndarray, strength: np.ndarray) -> Frame:
    """One row per pair a < b: the columns of pairhand.pairs()."""
    h = Hands(batch)
    whole = h.whole()
    steps, pair = h.steps()
    acting = np.flatnonzero(h.actor >= 0)
    a = h._others(acting, h.actor[acting])[0]
    x, y = h.pair_x[pair], h.pair_y[pair]
    cell, good = _cells(h, a, x)
    steps.columns |= {c: (np.nan_to_num(r[cell]), good) for c, r in zip(("pa", "pf", "pc"), rates_)}
    _open(h, batch, steps, pair, a, x, y, strength)
    hand, px, py = h.pair_hand, h.pair_x, h.pair_y
    number = lambda at: (np.append(h.a["action_no"][0], np.int16(0))[at], at < h.none)
    step = lambda c, at: np.append(h.a[c][0], h.a[c][0].dtype.type(0))[at]
    raiser = np.append(np.broadcast_to(np.asarray(h.a["l"][1]), h.actor.shape), False)
    pot, known = h.h["final_pot"]
    preflop = np.bincount(h.a["hand"][0], h.a["street"][0] == 0, h.size)
    count = lambda flag: np.bincount(h.s["hand"][0], flag, h.size)[hand]
    whole.columns |= {
        "sandwich": (_sandwiches(h, whole.size), True), "nvols": (count(h.vol < h.none), True), "npre": (preflop[hand], True), "nleft": (count(h.fold == h.none), True), "final_pot": (pot[hand], known if known is True else known[hand]),
        "xfirst_act": (step("action", h.first[px]), h.first[px] < h.none), "xfirst_l": (step("l", h.first[px]), raiser[h.first[px]]), "xpfr_no": number(h.pfr[px]), "xfold_no": number(h.fold[px]), "yaggr_no": number(h.aggr[py]), "yfirst_no": number(h.first[py]),
    }
    up = np.flatnonzero(h.place[px] < h.place[py])
    down = h.pair_off[hand[up]] + h.place[py[up]] * h.n[hand[up]] + h.place[px[up]]
    player, sides = h.s["player_idx"][0], {}
    for f, e in EVERY.items():
        v, filled = whole.value(m[1]) if (m := _WHOLE.match(e)) else _taken(e, steps, pair, whole.size)
        for side, at in (("x", up), ("y", down)):
            sides[f"{side}_{f}"] = v[at], filled if isinstance(filled, bool) else filled[at]
    both = Frame(sides, len(up))
    out = {"hand_idx": (batch.column("hand_idx").to_numpy()[hand[up]], True), "a": (player[px[up]], True), "b": (player[py[up]], True)}
    return Frame(out | {c: both.value(re.sub(r"\b([xy])\.(\w+)", r"\1_\2", e)) for c, e in pairhand.paired_columns(True).items()}, len(up))


def typed(rows: Frame, schema: pa.Schema) -> pa.Table:
    """The columns of a schema as a table; one that may not be null is checked."""

    def column(v: np.ndarray, filled: np.ndarray | bool, f: pa.Field) -> pa.Array:
        if not f.nullable and not np.all(filled):
            raise ValueError(f"{f.name} has nulls")
        mask = None if filled is True or not f.nullable else np.broadcast_to(~np.asarray(filled), v.shape)
        return pa.array(v if pa.types.is_string(f.type) else v.astype(f.type.to_pandas_dtype(), copy=False), f.type, mask=mask)

    return pa.table({f.name: column(*rows.columns[f.name], f) for f in schema}, schema)


def kinds(spark: SparkSession) -> StructType:
    """The columns of pairhand.pairs() with equities, as Spark types their expressions."""
    taken = [f"x__{c} {t}, y__{c} {t}" for c, t in (RAW | TAKEN).items()]
    inside = re.compile(rf"\b({'|'.join(RAW)})\b")
    whole = {f: m[1] for f, e in EVERY.items() if (m := _WHOLE.match(e))}
    sides = [F.expr(inside.sub(rf"{side}__\1", whole[f]) if f in whole else f"{side}__{f}").alias(f"{side}_{f}") for side in "xy" for f in EVERY]
    both = spark.createDataFrame([], "hand_idx int, a int, b int, " + ", ".join(taken)).select("hand_idx", "a", "b", *sides)
    return both.select("hand_idx", "a", "b", *(F.expr(re.sub(r"\b([xy])\.(\w+)", r"\1_\2", e)).alias(c) for c, e in pairhand.paired_columns(True).items())).schema


def pairs(hands: DataFrame, rates_: np.ndarray, then: Callable[[Frame], Frame] | None = None, schema: StructType | None = None) -> DataFrame:
    """pairhand.pairs() with equities of gathered() hands; or columns of the schema that `then` makes of its rows a batch at a time."""
    strength, schema = strengths(), schema or kinds(hands.sparkSession)
    arrow = to_arrow_schema(schema)

    def rows(batch: pa.Table) -> pa.Table:
        out = features(batch, rates_, strength)
        return typed(then(out) if then else out, arrow)

    return hands.mapInArrow(_slices(rows), schema)


# Signature flags of a row as bits of one number, and their counts by pair.

_FLAGS, _SUMS = pairhand.flags(True), pairhand.sums(True)
MARKS = StructType([StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("flags", LongType()), *(StructField(f"s_{k}", DoubleType()) for k in _SUMS)])


def marks(rows: Frame) -> Frame:
    """Pairs with their flags and sums."""
    bits = np.zeros(rows.size, np.int64)
    for i, e in enumerate(_FLAGS.values()):
        bits |= np.broadcast_to(np.asarray(rows.holds(e)), rows.size).astype(np.int64) << i
    return Frame({c: rows.columns[c] for c in "ab"} | {"flags": (bits, True)} | {f"s_{k}": rows.value(e) for k, e in _SUMS.items()}, rows.size)


def counted(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """marks() summed by pair, whose rows come to one task: (a, b, n, c_ of flags, s_ of sums); and n and c_ of all rows, in parts."""
    kept, counts = [f"s_{k}" for k in _SUMS], ["n", *(f"c_{k}" for k in _FLAGS)]
    of_all = StructType([StructField(c, LongType()) for c in counts])
    schema = StructType([*MARKS.fields[:2], *of_all.fields, *(StructField(c, DoubleType()) for c in kept)])
    arrow, arrow_all = to_arrow_schema(schema), to_arrow_schema(of_all)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, rows = None, [], 0

        def merged() -> tuple | None:
            parts = [_by_pair(pa.Table.from_batches(waiting).combine_chunks())] if waiting else []
            parts += [] if total is None else [total]
            return _summed(*(np.concatenate(x, -1) for x in zip(*parts))) if len(parts) > 1 else parts[0] if parts else None

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= max(WAITING, 0 if total is None else len(total[0])):  # so that sums are merged a few times only
                total, waiting, rows = merged(), [], 0
        total = merged()
        if total is not None:
            code, whole, sums = total
            pair = {"a": (code >> 32, True), "b": ((code & 0xFFFFFFFF) - (1 << 31), True)}
            yield from typed(Frame(pair | {c: (v, True) for c, v in zip(counts, whole)} | {c: (v, n > 0) for c, v, n in zip(kept, sums, whole[len(counts) :])}, len(code)), arrow).to_batches(10_000)

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(counts), np.int64)
        for batch in batches:
            bits = batch.column(2).to_numpy()
            total += [len(bits), *(np.count_nonzero(bits & (1 << i)) for i in range(len(_FLAGS)))]
        yield from typed(Frame({c: (np.array([v]), True) for c, v in zip(counts, total)}, 1), arrow_all).to_batches()

    by_pair = marked.repartition("a", "b")
    return by_pair.mapInArrow(count, schema), by_pair.mapInArrow(count_all, of_all)


def _by_pair(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, counts, sums) of marks(): n, flags, and how many of each sum are there."""
    (a, _), (b, _), (bits, _), *sums = map(plain, rows.columns)
    code = (a.astype(np.int64) << 32) + b + (1 << 31)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=code[order[:1]] - 1))
    bits, add = bits[order], lambda v: np.add.reduceat(v, first)
    there = [add(np.broadcast_to(f, len(a)).astype(np.int64)[order]) for _, f in sums]
    return code[order][first], np.stack([add(np.ones(len(a), np.int64)), *(add(bits >> i & 1) for i in range(len(_FLAGS))), *there]), np.stack([add(np.where(f, v, 0)[order]) for v, f in sums])


def _summed(code: np.ndarray, whole: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of columns over rows with the same code."""
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=code[order[:1]] - 1))
    return code[order][first], np.add.reduceat(whole[:, order], first, axis=1), np.add.reduceat(sums[:, order], first, axis=1)
