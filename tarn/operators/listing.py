"""Which events of a group get into a list of fixed length, and lists put together from scores."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 5


def _counts_before(p: np.ndarray, cap: int) -> np.ndarray:
    """p is (n, K). Row i of the result is, for each k, the law of how many of the first i succeed; `cap` or more are left out."""
    n, kinds = p.shape
    law = np.zeros((n + 1, kinds, cap))
    law[0, :, 0] = 1.0
    for i in range(n):
        law[i + 1] = law[i] * (1 - p[i])[:, None]
        law[i + 1, :, 1:] += law[i, :, :-1] * p[i][:, None]
    return law


def listed_probability(q: np.ndarray, types: np.ndarray, cap: int = CAP) -> np.ndarray:
    """q[i]: chance that the i-th row in time is an event; types[i, k]: its type then. Events are listed by type, then time, up
    to cap. The chance of row i: the sum over k of being an event of type k with fewer than cap events ahead, which are those
    of a lower type anywhere and those of type k earlier."""
    through = np.cumsum(types, axis=1)
    ahead_if_earlier, ahead_if_later = q[:, None] * through, q[:, None] * (through - types)
    left = _counts_before(ahead_if_earlier, cap)[:-1]
    right = _counts_before(ahead_if_later[::-1], cap)[:-1][::-1]
    room = np.einsum("ika,ikb->ik", left, np.cumsum(right, axis=2)[:, :, ::-1], optimize=True) if cap == 1 else (left * np.cumsum(right, axis=2)[:, :, ::-1]).sum(2)
    return (q[:, None] * types * room).sum(1)


def listing_probabilities(df: DataFrame, group: str, order: list[str], chance: str, types: list[str], cap: int = CAP) -> DataFrame:
    """Adds `p_listed` to every row. A group is what one pair has, some thousand rows at most; a null chance or type counts as 0.

    The number of tasks is fixed, as adaptive execution would join small partitions whose work is in their groups.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", p_listed double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, ignore_index=True)
        return frame.assign(p_listed=listed_probability(frame[chance].fillna(0).to_numpy(float), frame[types].fillna(0).to_numpy(float), cap))

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, group).groupBy(group).applyInPandas(run, schema)


@functools.cache
def _orders(n: int, length: int) -> np.ndarray:
    """Every ordered choice of `length` out of n places, one a row, in lexicographic order."""
    return np.array(list(itertools.permutations(range(n), length)), int).reshape(-1, length)


def best_order(p: np.ndarray, together: np.ndarray, length: int = CAP) -> tuple[int, ...]:
    """The ordered list of rows with the greatest expected average precision, given the chance p[i] that a row is relevant and
    together[i, j] that two are; a bounded search over at most 10 candidates."""
    rows = np.argsort(-p, kind="stable")[:10]
    orders = rows[_orders(len(rows), min(length, len(rows)))]
    value = np.zeros(len(orders))
    for r in range(orders.shape[1]):
        value += (p[orders[:, r]] + sum(together[orders[:, r], orders[:, j]] for j in range(r))) / (r + 1)
    return tuple(int(i) for i in orders[np.argmax(value >= value.max() - 1e-12)])


def greedy_candidates(scores: np.ndarray, kinds: np.ndarray, length: int) -> np.ndarray:
    """Rows, in order, among which greedy_slots() picks what it would pick among all: the `length` best of each kind."""
    order = np.argsort(-scores, kind="stable")
    place = pd.Series(kinds[order]).groupby(kinds[order]).cumcount().to_numpy()
    return np.sort(order[place < length])


def greedy_slots(scores: np.ndarray, kinds: np.ndarray, length: int, discount: float) -> list[int]:
    """Picks rows one by one by score, that of a kind already picked m times counting discount ** m; first row among equals."""
    left, picked, times = list(range(len(scores))), [], {}
    while left and len(picked) < length:
        i = max(left, key=lambda j: (scores[j] * discount ** times.get(kinds[j], 0), -j))
        picked.append(i)
        times[kinds[i]] = times.get(kinds[i], 0) + 1
        left.remove(i)
    return picked


def logit_shift(p: np.ndarray, target: float, steps: int = 48) -> np.ndarray:
    """Probabilities moved by one logit so that they sum to target, by bisection; target is clipped to the possible range."""
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(p, 1e-9, 1 - 1e-9))
    low, high = -30.0, 30.0
    for _ in range(steps):
        middle = (low + high) / 2
        if (1 / (1 + np.exp(-(z + middle)))).sum() < target:
            low = middle
        else:
            high = middle
    return 1 / (1 + np.exp(-(z + (low + high) / 2)))


def censored_poisson_rate(listed: np.ndarray, cap: int = CAP, steps: int = 60) -> float:
    """Rate of a Poisson count of which min(count, cap) is seen, at the greatest likelihood."""
    listed = np.minimum(np.asarray(listed), cap)
    low, high = 1e-9, 100.0

    def gain(rate: float) -> float:
        k = np.arange(cap)
        pmf = np.exp(k * np.log(rate) - rate - np.array([sum(np.log(np.arange(1, x + 1))) for x in k]))
        tail = max(1 - pmf.sum(), 1e-300)
        seen = listed < cap
        return float((listed[seen] / rate - 1).sum() + (~seen).sum() * pmf[-1] / tail)

    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if gain(middle) > 0 else (low, middle)
    return (low + high) / 2


def ramp(strength, low: float, high: float, weight: float):
    """weight * clip((strength - low) / (high - low), 0, 1)."""
    return F.lit(weight) * F.least(F.greatest((strength - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def compose(scores: DataFrame, posteriors: DataFrame, pair: str, item: str, classes: list[str], k: int = CAP, none: str = "NO_EVIDENCE") -> DataFrame:
    """(pair, item_1 .. item_k): the best items by sum of P_<class> * s_<class>, padded with `none`.

    Posteriors are scaled to sum to 1; without any, or without mass, they are even. Ties go by the greatest single score, then
    the item. Every pair of either side gets a row; repeated (pair, item) rows count once, by their greatest scores.
    """
    total = sum((F.coalesce(F.col(f"P_{c}"), F.lit(0.0)) for c in classes), F.lit(0.0))
    even = F.lit(1.0 / len(classes))
    p = posteriors.select(pair, *(F.when(total > 0, F.coalesce(F.col(f"P_{c}"), F.lit(0.0)) / total).otherwise(even).alias(f"P_{c}") for c in classes))
    s = scores.groupBy(pair, item).agg(*(F.coalesce(F.max(f"s_{c}"), F.lit(0.0)).alias(f"s_{c}") for c in classes))
    mixed = s.join(p, pair, "left").select(
        pair, item, F.round(sum((F.coalesce(F.col(f"P_{c}"), even) * F.col(f"s_{c}") for c in classes), F.lit(0.0)), 9).alias("mix"), F.greatest(*(f"s_{c}" for c in classes)).alias("top")
    )
    w = Window.partitionBy(pair).orderBy(F.col("mix").desc(), F.col("top").desc(), F.col(item))
    placed = mixed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    ids = posteriors.select(pair).unionByName(scores.select(pair)).distinct()
    slots = (F.coalesce(F.max(F.when(F.col("r") == i, F.col(item).cast("string"))), F.lit(none)).alias(f"item_{i}") for i in range(1, k + 1))
    return ids.join(placed, pair, "left").groupBy(pair).agg(*slots)
